"""Exact ranks, running sums and quantiles without single-task windows (W2, W3, A9 and what builds on them).

A window with no ``partitionBy`` (or one partitioned by a two-level class
label) moves all rows into one task.  Two primitives replace it:

* ``row_number``: rows are range-partitioned on (group keys, order keys, a
  hash of the row, a random number), sorted inside each partition and numbered
  there; the last two spread rows with equal order keys, so a value that a
  third of all rows share fills several partitions.
* ``cumulate``: running sums over *distinct* keys.  Everything about ties
  (mid-ranks, AUC, ROC, Kruskal-Wallis, quantiles) first becomes one row per
  distinct value with its count, by a hash aggregate that collapses ties
  before the shuffle, so a hot value is one row.

Both cut lineage with a reliable checkpoint, so partition numbers hold if an
executor is lost, and join back per-partition totals: a frame of at most
partitions + groups rows whose window runs over a group's partitions, which
is broadcast where a count shows at most ``BROADCAST_ROWS`` rows.  Nothing is
collected.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carrisk.session import checkpoint

POS_BITS = 33
BROADCAST_ROWS = 100_000


@dataclass
class Ranked:
    """Result of ``row_number``: the ranked frame."""
    df: DataFrame


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _partitions(df: DataFrame, n: int | None) -> int:
    if n:
        return n
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))


def _before(totals: DataFrame, by: Sequence[str], columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(``_pid``, by..., ``_off_*``, ``_all_*``): per partition and group, what earlier partitions and all of them hold.

    ``keep``: columns that go on unchanged, as ``_off_*``.
    """
    group = Window.partitionBy(*by)
    earlier = group.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("_pid", *by, *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_off_{c}") for c in columns],
                         *[F.sum(c).over(group).alias(f"_all_{c}") for c in columns], *[F.col(c).alias(f"_off_{c}") for c in keep])


def _joined(ranged: DataFrame, offsets: DataFrame, by: Sequence[str]) -> DataFrame:
    side = offsets.select(F.col("_pid").alias("_p2"), *[F.col(b).alias(f"_by{i}") for i, b in enumerate(by)],
                          *[c for c in offsets.columns if c.startswith(("_off_", "_all_"))])
    side = checkpoint(side)
    if side.count() <= BROADCAST_ROWS:  # else a shuffle join
        side = F.broadcast(side)
    cond = F.col("_pid") == F.col("_p2")
    for i, b in enumerate(by):
        cond = cond & F.col(b).eqNullSafe(F.col(f"_by{i}"))
    return ranged.join(side, cond)


def row_number(df: DataFrame, order: Sequence[str | Column], by: Sequence[str] = (), out: str = "rn",
               num_partitions: int | None = None, size: str | None = None) -> Ranked:
    """Exact ``row_number() over (partition by by order by order)``, and the group's size as column ``size``.

    ``order`` may hold Columns with ``asc``/``desc``; ties keep an arbitrary
    but fixed order (add a unique tie-break for a defined order).
    """
    by = list(by)
    ties = [F.xxhash64(*[F.col(c) for c in df.columns]).asc(), F.col("_rand").asc()]  # equal rows spread as well
    keys = [F.col(b).asc_nulls_first() for b in by] + [_col(o) for o in order] + ties
    ranged = (df.withColumn("_rand", F.rand(42)).repartitionByRange(_partitions(df, num_partitions), *keys).sortWithinPartitions(*keys)
              .withColumn("_mid", F.monotonically_increasing_id()))
    ranged = checkpoint(ranged.withColumns({
        "_pid": F.shiftright(F.col("_mid"), POS_BITS),
        "_pos": F.col("_mid").bitwiseAND(F.lit((1 << POS_BITS) - 1)),
    }).drop("_mid", "_rand"))
    runs = ranged.groupBy("_pid", *by).agg(F.count(F.lit(1)).alias("cnt"), F.min("_pos").alias("first"))
    joined = _joined(ranged, _before(runs, by, ["cnt"], ["first"]), by)
    extra = [F.col("_all_cnt").alias(size)] if size else []
    return Ranked(joined.select(*df.columns, (F.col("_pos") - F.col("_off_first") + F.col("_off_cnt") + 1).alias(out), *extra))


def cumulate(df: DataFrame, order: Sequence[str | Column], by: Sequence[str], sums: Mapping[str, str],
             totals: Mapping[str, str] | None = None, num_partitions: int | None = None) -> DataFrame:
    """``df`` + for each (column, out) of ``sums`` the column's sum over the group's earlier rows, and of
    ``totals`` its sum over the group.  The order must have no ties within a group."""
    by = list(by)
    totals = dict(totals or {})
    columns = list(dict.fromkeys([*sums, *totals]))
    keys = [F.col(b).asc_nulls_first() for b in by] + [_col(o) for o in order]
    ranged = checkpoint(df.repartitionByRange(_partitions(df, num_partitions), *keys).withColumn("_pid", F.spark_partition_id()))
    offsets = _before(ranged.groupBy("_pid", *by).agg(*[F.sum(c).alias(c) for c in columns]), by, columns)
    joined = _joined(ranged, offsets, by)
    local = Window.partitionBy("_pid", *by).orderBy(*[_col(o) for o in order]).rowsBetween(Window.unboundedPreceding, -1)
    return joined.select(*df.columns,
                         *[(F.coalesce(F.sum(c).over(local), F.lit(0)) + F.col(f"_off_{c}")).alias(out) for c, out in sums.items()],
                         *[F.col(f"_all_{c}").alias(out) for c, out in totals.items()])


def ntile(df: DataFrame, n_tiles: int, order: Sequence[str | Column], by: Sequence[str] = (),
          out: str = "ntile", null_col: str | None = None) -> DataFrame:
    """SQL ``ntile`` (larger buckets first) from exact row numbers.

    Rows whose ``null_col`` is NULL get a NULL bucket and are not counted.
    """
    src = df.where(F.col(null_col).isNotNull()) if null_col else df
    ranked = row_number(src, order, by, out="_rn", size="_size").df
    q = F.floor(F.col("_size") / F.lit(n_tiles))
    rem = F.col("_size") % F.lit(n_tiles)
    rn = F.col("_rn")
    big = rem * (q + 1)
    bucket = (F.when(rn <= big, F.floor((rn - 1) / (q + 1)) + 1)
              .otherwise(rem + F.floor((rn - big - 1) / q) + 1)).cast("int")
    res = ranked.withColumn(out, bucket).drop("_rn", "_size")
    if null_col:
        res = res.unionByName(df.where(F.col(null_col).isNull()).withColumn(out, F.lit(None).cast("int")))
    return res


def value_mid_ranks(df: DataFrame, value: str, by: Sequence[str] = (), extra_aggs: Sequence[Column] = ()) -> DataFrame:
    """W3 per distinct value: (by..., value, cnt[, extra aggs], mid_rank, n), n the group's size.

    Mid-rank = average of the row numbers a tie occupies.  Rows with a NULL
    value are excluded (R ``rank`` keeps NA last; callers drop them first).
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("cnt"), *extra_aggs)
    ranks = cumulate(counts, [F.col(value).asc()], by, {"cnt": "_before"}, {"cnt": "n"})
    return ranks.withColumn("mid_rank", F.col("_before") + (F.col("cnt") + 1) / F.lit(2.0)).drop("_before")


def mid_rank(df: DataFrame, value: str, by: Sequence[str] = (), out: str = "mid_rank") -> DataFrame:
    """W3 per row: average rank of ``value`` (ties share the mean rank)."""
    ranks = value_mid_ranks(df, value, by)
    keys = list(by) + [value]
    ranks = ranks.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("mid_rank").alias(out))
    cond = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    joined = df.join(ranks, cond, "left")
    return joined.select(*df.columns, out)


def quantiles(df: DataFrame, columns: Mapping[str, str | Column], probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Exact interpolated quantiles (R type 7): (by..., column, n, q), q an array in the order of ``probs``.

    All columns share one pass: rows become (column, value) counts in a hash
    aggregate, running counts place the ranks that bracket each probability,
    and the values there are interpolated.  A group without a value has n = 0
    and NULL quantiles.
    """
    by = list(by)
    pairs = F.array(*[F.struct(F.lit(name).alias("column"), _col(c).cast("double").alias("value")) for name, c in columns.items()])
    counts = df.select(*by, F.inline(pairs)).groupBy(*by, "column", "value").agg(F.count("value").alias("cnt"))
    runs = cumulate(counts, [F.col("value").asc_nulls_first()], [*by, "column"], {"cnt": "_before"}, {"cnt": "_n"})

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_before") <= rank) & (rank < F.col("_before") + F.col("cnt")), F.col("value")))

    aggs = []
    for i, p in enumerate(probs):
        place = (F.col("_n") - 1) * F.lit(float(p))
        aggs += [at(F.floor(place)).alias(f"_lo{i}"), at(F.ceil(place)).alias(f"_hi{i}")]
    wide = runs.groupBy(*by, "column").agg(F.max("_n").alias("n"), *aggs)
    out = []
    for i, p in enumerate(probs):
        place = (F.col("n") - 1) * F.lit(float(p))
        low, high = F.floor(place), F.ceil(place)
        out.append(F.when(low == high, F.col(f"_lo{i}")).otherwise((high - place) * F.col(f"_lo{i}") + (place - low) * F.col(f"_hi{i}")))
    return wide.select(*by, "column", "n", F.array(*out).alias("q"))
