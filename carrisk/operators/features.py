"""Carrier features, the binary target and the report-side type rebuild."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carrisk.functions import scalar as S

# Weights of the violation intensity score per violation group.
VIOLATION_WEIGHTS = {
    "viol_unsafe": 1.0,
    "viol_fatigued": 1.0,
    "viol_dr_fitness": 0.7,
    "viol_subt_alcohol": 1.5,
    "viol_vh_maint": 0.8,
    "viol_hm": 1.2,
}
# Operation codes A = interstate, B = intrastate hazmat, C = intrastate non-hazmat.
OPERATION_DUMMIES = {"is_interstate": "A", "is_intra_hazmat": "B", "is_intra_nonhaz": "C"}
TARGET_LEVELS = ("Clean", "OOS")


def add_features(master: DataFrame) -> DataFrame:
    """Rates, the weighted score, log fleet size and operation dummies (one projection)."""
    exprs = {
        "oos_rate": S.safe_div("sum_oos_total", "total_inspections"),
        "violation_intensity_score": S.weighted_score(VIOLATION_WEIGHTS),
        "crash_to_inspection_ratio": S.safe_div("total_crashes", "total_inspections"),
        "fatal_crash_rate": S.safe_div("total_fatalities", "total_crashes"),
        "injury_per_inspection": S.safe_div("total_injuries", "total_inspections"),
        "drivers_per_unit": S.safe_div("driver_total", "nbr_power_unit"),
        "fleet_size_log": S.log1p_floor("nbr_power_unit"),
    }
    exprs.update({name: S.dummy("carrier_operation", code) for name, code in OPERATION_DUMMIES.items()})
    return master.withColumns(exprs)


def add_target(master: DataFrame) -> DataFrame:
    """``oos_flag`` = OOS when the carrier has any OOS count, else Clean."""
    return master.withColumn("oos_flag", S.binary_label("sum_oos_total", "OOS", "Clean"))


def report_view(master: DataFrame) -> DataFrame:
    """Columns the report datasets add on top of the master (tri-state flags,
    hazmat status, inspected marker, raw violations per inspection)."""
    return master.withColumns({
        "hm_flag_lgl": S.tri_bool("hm_flag"),
        "pc_flag_lgl": S.tri_bool("pc_flag"),
    }).withColumns({
        "HM_Status": F.when(F.col("hm_flag_lgl"), F.lit("Hazmat"))
                      .when(~F.col("hm_flag_lgl"), F.lit("Non-Hazmat")),
        "has_inspection": F.col("total_inspections") >= 1,
        "raw_viol_per_insp": S.guarded_ratio("sum_basic_viol", "total_inspections"),
    })
