"""Reference SQL for the correctness oracle (DuckDB dialect, portable subset).

``with_master(select)`` prefixes a query with the CTE chain that rebuilds the
master from the driver tables: binding -> cleaning -> rollups -> merge ->
imputation -> features.  Outputs are normalised like the Spark side
(``plans.registry.finish``): doubles rounded to 6 places with ``-0.0``
folded into ``0.0``, dates as ISO text.
"""

from __future__ import annotations

from carrisk.operators.rollup import CRASH_SUMS, INSPECTION_SUMS, ZERO_FILL
from carrisk.sources.binding import BINDING_SQL

WS = "' '||chr(9)||chr(13)||chr(10)"
YES = "('Y','YES','1','T','TRUE')"
NO = "('N','NO','FALSE','F','0')"

INSPECTION_NUMERIC = [
    "driver_oos_total", "vehicle_oos_total", "oos_total", "hazmat_oos_total", "basic_viol",
    "unsafe_viol", "fatigued_viol", "dr_fitness_viol", "subt_alcohol_viol", "vh_maint_viol", "hm_viol",
]
INSPECTION_FLAGS = ["unsafe_insp", "fatigued_insp", "dr_fitness_insp", "subt_alcohol_insp",
                    "vh_maint_insp", "hm_insp"]
# master columns that are doubles (rounded on output)
MASTER_DOUBLES = [
    "nbr_power_unit", "driver_total", "sum_oos_total", "sum_driver_oos", "sum_vehicle_oos",
    "sum_hazmat_oos", "sum_basic_viol", "viol_unsafe", "viol_fatigued", "viol_dr_fitness",
    "viol_subt_alcohol", "viol_vh_maint", "viol_hm", "total_fatalities", "total_injuries",
    "sum_severity_weight", "oos_rate", "violation_intensity_score", "crash_to_inspection_ratio",
    "fatal_crash_rate", "injury_per_inspection", "drivers_per_unit", "fleet_size_log",
]


def r6(expr: str) -> str:
    """Round a double expression like the Spark side does."""
    return f"(round(cast({expr} as double), 6) + 0.0)"


def trim(expr: str) -> str:
    return f"trim(cast({expr} as varchar), {WS})"


def yn(expr: str) -> str:
    return f"cast(coalesce(upper({trim(expr)}) in {YES}, false) as integer)"


def tri(expr: str) -> str:
    return (f"(case when upper({trim(expr)}) in {YES} then true "
            f"when upper({trim(expr)}) in {NO} then false end)")


def safe_div(x: str, y: str) -> str:
    return f"(case when {y} is null or {y} = 0 then cast(0.0 as double) else cast({x} as double) / cast({y} as double) end)"


def zsum(expr: str, as_type: str | None = None) -> str:
    s = f"coalesce(sum({expr}), 0)"
    return f"cast({s} as {as_type})" if as_type else s


def _clean_ctes() -> list[tuple[str, str]]:
    ctes = [(name, body) for name, body in BINDING_SQL.items()]
    ctes.append(("census", f"""
select {trim('dot_number')} as dot_number, cast(nbr_power_unit as double) as nbr_power_unit,
  cast(driver_total as double) as driver_total, upper({trim('carrier_operation')}) as carrier_operation,
  {yn('hm_flag')} as hm_flag, {yn('pc_flag')} as pc_flag, dba_name, phy_state
from census_raw where {trim('dot_number')} is not null and {trim('dot_number')} <> ''"""))
    nums = ",\n  ".join(f"cast({c} as double) as {c}" for c in INSPECTION_NUMERIC)
    flags = ",\n  ".join(f"{yn(c)} as {c}" for c in INSPECTION_FLAGS)
    ctes.append(("inspection", f"""
select {trim('dot_number')} as dot_number, {trim('unique_id')} as unique_id, insp_date,
  {nums},
  {flags}
from inspection_raw where {trim('dot_number')} is not null and {trim('dot_number')} <> ''"""))
    ctes.append(("violation", f"""
select {trim('inspection_id')} as inspection_id, {yn('out_of_service_indicator')} as out_of_service_flag
from violation_raw where {trim('inspection_id')} is not null and {trim('inspection_id')} <> ''"""))
    ctes.append(("crash_all", f"""
select {trim('dot_number')} as dot_number, cast(fatalities as double) as fatalities,
  cast(injuries as double) as injuries, cast(severity_weight as double) as severity_weight,
  {yn('tow_away')} as tow_away, {yn('hazmat_released')} as hazmat_released,
  {yn('not_preventable')} as not_preventable, report_date
from crash_raw where {trim('dot_number')} is not null and {trim('dot_number')} <> ''"""))
    ctes.append(("crash", "select * from crash_all where not_preventable = 0"))
    return ctes


def _rollup_ctes() -> list[tuple[str, str]]:
    flag_sources = set(INSPECTION_FLAGS)
    ins = ",\n  ".join(
        f"{zsum(src, 'bigint' if src in flag_sources else None)} as {out}" for out, src in INSPECTION_SUMS.items())
    cr = ",\n  ".join(
        f"{zsum(src, 'bigint' if src in ('tow_away', 'hazmat_released') else None)} as {out}"
        for out, src in CRASH_SUMS.items())
    return [
        ("insp_agg", f"""
select dot_number, count(*) as total_inspections,
  {ins},
  max(insp_date) as last_inspection
from inspection group by dot_number"""),
        ("viol_bridge", """
select v.inspection_id, v.out_of_service_flag, i.dot_number
from violation v join inspection i on v.inspection_id = i.unique_id"""),
        ("viol_agg", f"""
select dot_number, count(*) as total_violations_recorded,
  {zsum('out_of_service_flag', 'bigint')} as total_oos_violations
from viol_bridge group by dot_number"""),
        ("crash_agg", f"""
select dot_number, count(*) as total_crashes,
  {cr}
from crash group by dot_number"""),
    ]


def _master_ctes() -> list[tuple[str, str]]:
    fills = ",\n  ".join(f"coalesce({c}, 0) as {c}" for c in ZERO_FILL)
    return [
        ("merged_raw", """
select c.*, ia.* exclude (dot_number), va.* exclude (dot_number), ca.* exclude (dot_number)
from census c left join insp_agg ia on c.dot_number = ia.dot_number
  left join viol_agg va on c.dot_number = va.dot_number
  left join crash_agg ca on c.dot_number = ca.dot_number"""),
        ("merged", f"select * replace (\n  {fills})\nfrom merged_raw"),
        ("medians", "select median(nbr_power_unit) as m_npu, median(driver_total) as m_dt from merged"),
        ("imputed", """
select m.* replace (coalesce(m.nbr_power_unit, md.m_npu) as nbr_power_unit,
                    coalesce(m.driver_total, md.m_dt) as driver_total,
                    coalesce(m.dba_name, 'UNKNOWN') as dba_name)
from merged m, medians md where m.phy_state is not null"""),
        ("master", f"""
select *,
  {safe_div('sum_oos_total', 'total_inspections')} as oos_rate,
  cast(1.0 as double)*viol_unsafe + cast(1.0 as double)*viol_fatigued + cast(0.7 as double)*viol_dr_fitness
    + cast(1.5 as double)*viol_subt_alcohol + cast(0.8 as double)*viol_vh_maint + cast(1.2 as double)*viol_hm
    as violation_intensity_score,
  {safe_div('total_crashes', 'total_inspections')} as crash_to_inspection_ratio,
  {safe_div('total_fatalities', 'total_crashes')} as fatal_crash_rate,
  {safe_div('total_injuries', 'total_inspections')} as injury_per_inspection,
  {safe_div('driver_total', 'nbr_power_unit')} as drivers_per_unit,
  ln(1 + greatest(nbr_power_unit, 0.0)) as fleet_size_log,
  cast(carrier_operation = 'A' as integer) as is_interstate,
  cast(carrier_operation = 'B' as integer) as is_intra_hazmat,
  cast(carrier_operation = 'C' as integer) as is_intra_nonhaz,
  case when sum_oos_total > 0 then 'OOS' when sum_oos_total is not null then 'Clean' end as oos_flag
from imputed"""),
        ("rv", f"""
select *, {tri('hm_flag')} as hm_flag_lgl, {tri('pc_flag')} as pc_flag_lgl,
  case when {tri('hm_flag')} then 'Hazmat' when not {tri('hm_flag')} then 'Non-Hazmat' end as HM_Status,
  total_inspections >= 1 as has_inspection,
  case when total_inspections is null then null when total_inspections > 0
       then cast(sum_basic_viol as double) / total_inspections else cast(0.0 as double) end as raw_viol_per_insp
from master"""),
    ]


def ctes(extra: list[tuple[str, str]] | None = None) -> str:
    parts = _clean_ctes() + _rollup_ctes() + _master_ctes() + (extra or [])
    return "with " + ",\n".join(f"{name} as ({body}\n)" for name, body in parts) + "\n"


def with_master(select: str, extra: list[tuple[str, str]] | None = None) -> str:
    """Prefix ``select`` with the master CTE chain (``master`` and report view ``rv``)."""
    return ctes(extra) + select
