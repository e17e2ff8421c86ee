"""Carrier-grain rollups (A1-A3), the bridge join (J1), the master merge
and its integrity check (J7).

Scale notes.  Every child table is aggregated *before* it is joined, so each
join is 1:1 on ``dot_number`` and never fans out.  Hash aggregates run a
map-side partial step, so a carrier holding a third of all inspections is
collapsed inside each map task before the shuffle.  ``carrier_rollup`` fuses
A1 and A2: violation lines are pre-aggregated per inspection, left-joined to
the inspection rows and summed per carrier in the same pass as the
inspection sums, which saves one shuffle of the largest table and one join
compared with rolling the two up separately.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# output name -> inspection column summed (null-skipping, all-NULL -> 0)
INSPECTION_SUMS: dict[str, str] = {
    "sum_oos_total": "oos_total",
    "sum_driver_oos": "driver_oos_total",
    "sum_vehicle_oos": "vehicle_oos_total",
    "sum_hazmat_oos": "hazmat_oos_total",
    "sum_basic_viol": "basic_viol",
    "viol_unsafe": "unsafe_viol",
    "viol_fatigued": "fatigued_viol",
    "viol_dr_fitness": "dr_fitness_viol",
    "viol_subt_alcohol": "subt_alcohol_viol",
    "viol_vh_maint": "vh_maint_viol",
    "viol_hm": "hm_viol",
    "insp_unsafe": "unsafe_insp",
    "insp_fatigued": "fatigued_insp",
    "insp_dr_fitness": "dr_fitness_insp",
    "insp_subt_alcohol": "subt_alcohol_insp",
    "insp_vh_maint": "vh_maint_insp",
    "insp_hm": "hm_insp",
}
CRASH_SUMS: dict[str, str] = {
    "total_fatalities": "fatalities",
    "total_injuries": "injuries",
    "total_tow_away": "tow_away",
    "total_hazmat_release": "hazmat_released",
    "sum_severity_weight": "severity_weight",
}
# Structural zeros after the left joins (no child row = no events).
ZERO_FILL = (
    "total_inspections", "sum_oos_total", "sum_driver_oos", "sum_vehicle_oos",
    "sum_hazmat_oos", "sum_basic_viol", "viol_unsafe", "viol_fatigued",
    "viol_dr_fitness", "viol_subt_alcohol", "viol_vh_maint", "viol_hm",
    "insp_unsafe", "insp_fatigued", "insp_dr_fitness", "insp_subt_alcohol",
    "insp_vh_maint", "insp_hm", "total_violations_recorded", "total_oos_violations",
    "total_crashes", "total_fatalities", "total_injuries", "total_tow_away",
    "total_hazmat_release", "sum_severity_weight",
)


def _zsum(c: str) -> Column:
    return F.coalesce(F.sum(F.col(c)), F.lit(0))


def _inspection_aggs() -> list[Column]:
    aggs = [F.count(F.lit(1)).alias("total_inspections")]
    aggs += [_zsum(src).alias(out) for out, src in INSPECTION_SUMS.items()]
    aggs.append(F.max("insp_date").alias("last_inspection"))
    return aggs


def insp_agg(inspection: DataFrame) -> DataFrame:
    """A1: per carrier, 1 count + 17 sums + last inspection date."""
    return inspection.groupBy("dot_number").agg(*_inspection_aggs())


def bridge_join(violation: DataFrame, inspection: DataFrame) -> DataFrame:
    """Violation line -> inspection -> carrier (inner, differently named keys).

    Only the two key columns of the inspection side are read (pruned build side).
    """
    parents = inspection.select(F.col("unique_id"), F.col("dot_number"))
    return violation.join(parents, violation["inspection_id"] == parents["unique_id"], "inner").drop("unique_id")


def viol_agg(violation: DataFrame, inspection: DataFrame) -> DataFrame:
    """A2: per carrier, violation lines and OOS lines (through the bridge)."""
    return (bridge_join(violation, inspection).groupBy("dot_number").agg(
        F.count(F.lit(1)).alias("total_violations_recorded"),
        _zsum("out_of_service_flag").alias("total_oos_violations")))


def crash_agg(crash: DataFrame) -> DataFrame:
    """A3: per carrier, crash count + 5 sums."""
    aggs = [F.count(F.lit(1)).alias("total_crashes")]
    aggs += [_zsum(src).alias(out) for out, src in CRASH_SUMS.items()]
    return crash.groupBy("dot_number").agg(*aggs)


def violations_per_inspection(violation: DataFrame) -> DataFrame:
    """Pre-aggregate violation lines to one row per inspection id."""
    return violation.groupBy("inspection_id").agg(
        F.count(F.lit(1)).alias("_n_viol"),
        _zsum("out_of_service_flag").alias("_n_oos"))


def carrier_rollup(inspection: DataFrame, violation: DataFrame) -> DataFrame:
    """A1 + A2 fused: one row per inspected carrier with both sets of columns.

    Equal to ``insp_agg`` joined with ``viol_agg``: a duplicated inspection id
    counts its violations once per inspection row, exactly as the inner bridge
    join fans them out.
    """
    per_insp = violations_per_inspection(violation)
    joined = inspection.join(per_insp, inspection["unique_id"] == per_insp["inspection_id"], "left")
    aggs = _inspection_aggs() + [
        _zsum("_n_viol").alias("total_violations_recorded"),
        _zsum("_n_oos").alias("total_oos_violations"),
    ]
    return joined.groupBy("dot_number").agg(*aggs)


def zero_fill(df: DataFrame, columns=ZERO_FILL) -> DataFrame:
    """Structural zero-fill of the event columns present in ``df``."""
    cols = [c for c in columns if c in df.columns]
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(0).cast(df.schema[c].dataType)) for c in cols})


def master_merge(census: DataFrame, *children: DataFrame) -> DataFrame:
    """Left-join carrier-grain children onto the census base, then N5.

    Each child is one row per ``dot_number`` (an aggregate), so the row count
    is preserved; the aggregates are already hash-partitioned by the key and
    the joins share that partitioning.
    """
    out = census
    for child in children:
        out = out.join(child, "dot_number", "left")
    return zero_fill(out)


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once (F20 check before a bridge join)."""
    return df.groupBy(key).count().where(F.col("count") > 1)


def merge_integrity(census: DataFrame, master: DataFrame, inspection: DataFrame | None = None,
                    raise_on_error: bool = True) -> DataFrame:
    """Rows after merge == rows before, plus duplicate parent ids.

    Counts run as Spark jobs; only the scalars reach the driver.
    """
    n_before = census.count()
    n_after = master.count()
    rows = [("census_rows", n_before), ("master_rows", n_after)]
    if inspection is not None:
        rows.append(("duplicate_unique_ids", duplicate_keys(inspection, "unique_id").count()))
    if raise_on_error and n_before != n_after:
        raise AssertionError(f"merge fan-out: census {n_before} rows, master {n_after} rows")
    rows.append(("merge_ok", int(n_before == n_after)))
    return census.sparkSession.createDataFrame(rows, "check string, value long")
