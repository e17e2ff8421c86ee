"""Per-table cleaning, key filters, de-duplication and missing-data reports.

Columns are cleaned only when present (the inputs vary by data vintage).
All steps are narrow projections/filters except ``dedupe_keep_first``,
whose hash aggregate by key also leaves the carrier table partitioned by
``dot_number`` for the merge that follows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carrisk.functions import scalar as S

# Column groups of the raw tables (fixed by the raw file layout).
CENSUS_NUMERIC = ("nbr_power_unit", "driver_total", "mcs150_mileage", "recent_mileage")
CENSUS_FLAGS = ("hm_flag", "pc_flag", "private_only", "authorized_for_hire")
INSPECTION_NUMERIC = (
    "driver_oos_total", "vehicle_oos_total", "oos_total", "hazmat_oos_total",
    "total_hazmat_sent", "basic_viol", "unsafe_viol", "fatigued_viol",
    "dr_fitness_viol", "subt_alcohol_viol", "vh_maint_viol", "hm_viol", "time_weight",
)
INSPECTION_FLAGS = (
    "unsafe_insp", "fatigued_insp", "dr_fitness_insp", "subt_alcohol_insp",
    "vh_maint_insp", "hm_insp", "hazmat_placard_req",
)
CRASH_NUMERIC = ("fatalities", "injuries", "severity_weight")
CRASH_FLAGS = ("tow_away", "hazmat_released", "not_preventable")


def present(df: DataFrame, names: Sequence[str]) -> list[str]:
    """Names from ``names`` that exist in ``df`` (the ``any_of`` guard)."""
    have = set(df.columns)
    return [n for n in names if n in have]


def key_present(c: str | Column) -> Column:
    """Key is neither NULL nor blank."""
    col = F.col(c) if isinstance(c, str) else c
    return col.isNotNull() & (col != F.lit(""))


def filter_keys(df: DataFrame, key: str) -> DataFrame:
    return df.where(key_present(key))


def _date_expr(df: DataFrame, name: str) -> Column:
    dtype = df.schema[name].dataType
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.col(name).cast("date")
    return S.to_date_safe(name)


def _num_expr(df: DataFrame, name: str) -> Column:
    """P3 on a column: typed numbers are cast, text goes through ``to_num``."""
    if isinstance(df.schema[name].dataType, T.NumericType):
        return F.col(name).cast("double")
    return S.to_num(name)


def dedupe_keep_first(df: DataFrame, key: str, order: str | Column | None = None) -> DataFrame:
    """One row per key, keeping the row with the smallest ``order``.

    ``order`` defaults to the input position.  A hash aggregate with
    ``min_by`` is used instead of a per-key window: partial aggregation
    collapses a hot key inside each map task before the shuffle.
    """
    payload = [c for c in df.columns if c != key]
    src = df.withColumn("_ord", F.monotonically_increasing_id() if order is None
                        else (F.col(order) if isinstance(order, str) else order))
    out = src.groupBy(key).agg(F.min_by(F.struct(*payload), F.col("_ord")).alias("_row"))
    return out.select(key, *[F.col(f"_row.{c}").alias(c) for c in payload])


def clean_census(raw: DataFrame, dedupe: bool = True) -> DataFrame:
    """Census: trimmed key, numbers, 0/1 flags, upper-case operation; unique key."""
    exprs = {"dot_number": S.clean_key("dot_number")}
    exprs.update({c: _num_expr(raw, c) for c in present(raw, CENSUS_NUMERIC)})
    exprs.update({c: S.yn_flag(c) for c in present(raw, CENSUS_FLAGS)})
    if "carrier_operation" in raw.columns:
        exprs["carrier_operation"] = S.clean_category("carrier_operation")
    out = raw.withColumns(exprs).where(key_present("dot_number"))
    return dedupe_keep_first(out, "dot_number") if dedupe else out


def clean_inspection(raw: DataFrame) -> DataFrame:
    exprs = {"dot_number": S.clean_key("dot_number"), "unique_id": S.clean_key("unique_id")}
    if "insp_date" in raw.columns:
        exprs["insp_date"] = _date_expr(raw, "insp_date")
    exprs.update({c: _num_expr(raw, c) for c in present(raw, INSPECTION_NUMERIC)})
    exprs.update({c: S.yn_flag(c) for c in present(raw, INSPECTION_FLAGS)})
    return raw.withColumns(exprs).where(key_present("dot_number"))


def clean_violation(raw: DataFrame) -> DataFrame:
    return (raw.withColumns({
        "inspection_id": S.clean_key("inspection_id"),
        "out_of_service_flag": S.yn_flag("out_of_service_indicator"),
    }).where(key_present("inspection_id")))


def clean_crash(raw: DataFrame, apply_exclusion: bool = True) -> DataFrame:
    exprs = {"dot_number": S.clean_key("dot_number")}
    exprs.update({c: _num_expr(raw, c) for c in present(raw, CRASH_NUMERIC)})
    exprs.update({c: S.yn_flag(c) for c in present(raw, CRASH_FLAGS)})
    if "report_date" in raw.columns:
        exprs["report_date"] = _date_expr(raw, "report_date")
    out = raw.withColumns(exprs).where(key_present("dot_number"))
    return crash_exclusion(out) if apply_exclusion else out


def crash_exclusion(crash: DataFrame) -> DataFrame:
    """Drop not-preventable crashes.  The flag is never NULL (0/1 parser),
    so missing counts as preventable."""
    return crash.where(F.col("not_preventable") == 0)


def inspected_universe(df: DataFrame) -> DataFrame:
    """Carriers with at least one inspection."""
    return df.where(F.col("total_inspections") >= 1)


def drop_na_rows(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with NULL (or NaN) in ``subset`` (all columns by default)."""
    return df.dropna(how="any", subset=list(subset) if subset else None)


def _is_missing(df: DataFrame, name: str) -> Column:
    col = F.col(name)
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return col.isNull() | F.isnan(col)
    return col.isNull()


def missing_profile(df: DataFrame, top: int | None = 25, only_missing: bool = True) -> DataFrame:
    """Percent missing per column in one pass, long, sorted desc, top n.

    Ties are broken by column name so the cut at ``top`` is deterministic.
    """
    wide = df.agg(*[(F.avg(_is_missing(df, c).cast("double")) * 100.0).alias(c) for c in df.columns])
    long = wide.unpivot([], df.columns, "column", "missing_pct")
    if only_missing:
        long = long.where(F.col("missing_pct") > 0)
    long = long.orderBy(F.desc_nulls_last("missing_pct"), F.asc("column"))
    return long.limit(top) if top else long


def null_counts(df: DataFrame) -> DataFrame:
    """Null count per column (long), one pass."""
    wide = df.agg(*[F.count_if(_is_missing(df, c)).alias(c) for c in df.columns])
    return wide.unpivot([], df.columns, "column", "n_missing")


def required_columns(df: DataFrame, needed: Sequence[str]) -> DataFrame:
    """(column, present, n_values): which required columns there are, and their non-NULL rows, in one aggregate."""
    have = set(df.columns)
    wide = df.agg(*[(F.count(F.col(f"`{c}`")) if c in have else F.lit(0).cast("long")).alias(c) for c in needed])
    return wide.unpivot([], list(needed), "column", "n_values").select(
        "column", F.col("column").isin(*have).alias("present"), "n_values")
