"""Report aggregates (A4-A13), shares and top-k (W1, W4-W7), reshapes.

Every aggregate is a hash aggregate with a map-side partial step; windows
appear only on already-aggregated (report-size) frames.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carrisk.operators import rank


def freq_count(df: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    """A4: counts per key combination; NULL is its own group."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def share_of_pred(pred: Column) -> Column:
    """A5: share of rows where ``pred`` holds (NULL predicate counts as false)."""
    return F.avg(F.coalesce(pred, F.lit(False)).cast("double"))


def grouped_share(df: DataFrame, keys: Sequence[str], pred: Column, name: str = "share") -> DataFrame:
    """A5: per group, share of rows meeting ``pred`` and the group size."""
    return df.groupBy(*keys).agg(share_of_pred(pred).alias(name), F.count(F.lit(1)).alias("n"))


def grouped_means(df: DataFrame, keys: Sequence[str], columns: Mapping[str, str | Column]) -> DataFrame:
    """A5: NULL-skipping means per group (``mean(x, na.rm=TRUE)``)."""
    aggs = [F.avg(F.col(v) if isinstance(v, str) else v).alias(k) for k, v in columns.items()]
    return df.groupBy(*keys).agg(*aggs)


def ratio_of_sums(df: DataFrame, keys: Sequence[str], num: str | Column, den: str | Column,
                  name: str = "ratio", count: str = "n") -> DataFrame:
    """sum(num) / sum(den) per group (NULL when the denominator sums to 0), and the group's rows as ``count``."""
    n = F.col(num) if isinstance(num, str) else num
    d = F.col(den) if isinstance(den, str) else den
    sd = F.sum(d.cast("double"))
    return df.groupBy(*keys).agg(
        F.sum(n.cast("double")).alias("num"), sd.alias("den"),
        F.when(sd != 0, F.sum(n.cast("double")) / sd).alias(name), F.count(F.lit(1)).alias(count))


def group_sums(df: DataFrame, keys: Sequence[str], columns: Mapping[str, str], count: str = "n") -> DataFrame:
    """Null-skipping sums per group (all-NULL groups give 0), and the group's rows as ``count``."""
    return df.groupBy(*keys).agg(*[F.coalesce(F.sum(F.col(src)), F.lit(0)).alias(out)
                                   for out, src in columns.items()], F.count(F.lit(1)).alias(count))


def min_group_size(grouped: DataFrame, n_col: str, minimum: int) -> DataFrame:
    """Keep groups with at least ``minimum`` rows (a HAVING filter)."""
    return grouped.where(F.col(n_col) >= F.lit(minimum))


def exact_quantiles(df: DataFrame, column: str, probs: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """Interpolated quantiles (R type 7) from distributed ranks, long form."""
    arr = F.array(*[F.lit(float(p)) for p in probs])
    wide = rank.quantiles(df, {column: column}, probs, keys)
    pairs = F.arrays_zip(arr.alias("prob"), F.col("q").alias("value"))
    return wide.select(*keys, F.inline(pairs))


def numeric_summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """A10: min, quartiles, mean, max, NULL count per numeric column, long form.

    One aggregate for the sums, and one pass of value counts for all quartiles.
    """
    cols = columns or [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [F.min(x).alias(f"{c}__min"),
                 F.avg(x).alias(f"{c}__mean"), F.max(x).alias(f"{c}__max"),
                 F.count_if(F.col(c).isNull()).alias(f"{c}__na")]
    wide = df.agg(*aggs)
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"{c}__min").alias("min"), F.col(f"{c}__mean").alias("mean"),
                     F.col(f"{c}__max").alias("max"), F.col(f"{c}__na").alias("n_missing"))
            for c in cols]
    quart = rank.quantiles(df, {c: c for c in cols}, [0.25, 0.5, 0.75]).select(F.col("column").alias("_c"), "q")
    long = wide.select(F.inline(F.array(*rows)))
    return long.join(quart, F.col("column") == F.col("_c"), "left").select(
        "column", "min", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), "mean", F.col("q")[2].alias("q3"), "max", "n_missing")


def corr_pairwise(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson r for every column pair, pairwise-complete, one pass; long (a, b, r)."""
    cols = [c for c in columns if c in df.columns]
    pairs = list(combinations(cols, 2))
    aggs = [F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}__{b}") for a, b in pairs]
    wide = df.agg(*aggs)
    rows = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}__{b}").alias("r")) for a, b in pairs]
    return wide.select(F.inline(F.array(*rows)))


def corr_complete(df: DataFrame, columns: Sequence[str], fill_zero: bool = True) -> DataFrame:
    """Correlation on complete rows (after the 0-fill), long (a, b, r).

    Same single pass as A12 once NULLs are filled; on a frame with no NULLs the
    pairwise and complete-case matrices coincide.
    """
    cols = [c for c in columns if c in df.columns]
    src = df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) if fill_zero else F.col(c)
                      for c in cols])
    if not fill_zero:
        src = src.dropna()
    return corr_pairwise(src, cols)


def share_within(df: DataFrame, n_col: str, keys: Sequence[str] = (), name: str = "pct") -> DataFrame:
    """N / sum(n) within ``keys`` (of the total when empty), on an aggregated frame."""
    w = Window.partitionBy(*keys) if keys else Window.partitionBy()
    return df.withColumn(name, F.col(n_col) / F.sum(n_col).over(w))


def class_balance(df: DataFrame, label: str) -> DataFrame:
    """N and share per class."""
    return share_within(freq_count(df, label), "n")


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """First k rows by ``order`` (no ties; add a key tie-break for determinism)."""
    return df.orderBy(*order).limit(k)


def top_k_ties(df: DataFrame, order: Sequence[Column], k: int, keys: Sequence[str] = ()) -> DataFrame:
    """Rows whose rank is <= k (keeps ties at position k), on an aggregated frame."""
    w = Window.partitionBy(*keys).orderBy(*order) if keys else Window.orderBy(*order)
    return df.withColumn("_rk", F.rank().over(w)).where(F.col("_rk") <= k).drop("_rk")


def argmax_row(df: DataFrame, value: str, keys: Sequence[str] = (), tie: Sequence[Column] = ()) -> DataFrame:
    """The row with the largest ``value`` (the least by ``tie`` among equals) per group, in one aggregate.

    Rows without a value never win; a group without any gives no row.
    """
    others = [c for c in df.columns if c not in keys]
    order = F.struct((-F.col(value).cast("double")).alias("_v"), *[t.alias(f"_t{i}") for i, t in enumerate(tie)])
    return (df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.min_by(F.struct(*others), order).alias("_best"))
            .select(*keys, *[F.col(f"_best.{c}").alias(c) for c in others]))


def unpivot_long(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str = "name",
                 value: str = "value", cast: str | None = "double") -> DataFrame:
    """Wide -> long (values cast to one type first)."""
    def q(c: str) -> Column:
        return F.col(f"`{c}`")
    src = df.select(*[q(i) for i in ids], *[q(v).cast(cast).alias(v) if cast else q(v) for v in values])
    return src.unpivot([q(i) for i in ids], [q(v) for v in values], name, value)


def stack_labelled(frames: Mapping[str, DataFrame], label: str = "label") -> DataFrame:
    """Bag union of frames, each tagged with its label (rows may repeat)."""
    out = None
    for name, df in frames.items():
        tagged = df.withColumn(label, F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def pivot_table(long: DataFrame, row: str, col: str, value: str, levels: Sequence[str]) -> DataFrame:
    """Long (row, col, value) -> one column per level of ``col`` (levels given, no extra pass)."""
    return long.groupBy(row).pivot(col, list(levels)).agg(F.first(value))
