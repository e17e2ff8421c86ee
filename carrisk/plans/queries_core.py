"""Registered queries: sources, cleaning, rollups, merge, imputation, features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carrisk.functions import scalar as S
from carrisk.operators import clean, features, rollup
from carrisk.operators.impute import MissingPolicy, drop_missing_geo, fit_medians, impute_median, impute_unknown
from carrisk.plans import master as M
from carrisk.plans import oracle as O
from carrisk.plans.oracle import MASTER_DOUBLES, r6, with_master
from carrisk.plans.registry import query
from carrisk.sources import binding, files


def _master_select(extra_doubles=(), dates=("last_inspection",), source="master") -> str:
    reps = [f"{r6(c)} as {c}" for c in list(MASTER_DOUBLES) + list(extra_doubles)]
    reps += [f"cast({d} as varchar) as {d}" for d in dates]
    return f"select * replace ({', '.join(reps)}) from {source}"


# ---------------------------------------------------------------- sources
@query("src_csv_roundtrip", with_master("""
select dot_number, total_inspections, sum_oos_total, oos_flag, phy_state from master"""))
def q_src_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1 + S4 (CSV option): write master columns as headed CSV, read back as text, re-type."""
    m = M.master_for(spark, sf_dir).select("dot_number", "total_inspections", "sum_oos_total",
                                          "oos_flag", "phy_state")
    path = M.scratch_path(spark, "csv-roundtrip-" + M.hashlib.sha1(sf_dir.encode()).hexdigest()[:12])
    files.write_csv(m, path)
    raw = files.read_raw(spark, path, m.columns)
    return raw.select(
        S.clean_key("dot_number").alias("dot_number"),
        S.to_num("total_inspections").cast("long").alias("total_inspections"),
        S.to_num("sum_oos_total").alias("sum_oos_total"),
        F.col("oos_flag"), F.col("phy_state"))


@query("raw_files_master", with_master(_master_select()))
def q_raw_files_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1 to entry 1: the four raw tables as headed CSV files -> ``load_raw`` -> cleaning -> checked merge -> master."""
    raw = binding.bind(spark, sf_dir)
    base = M.scratch_path(spark, "raw-files-" + M.hashlib.sha1(sf_dir.encode()).hexdigest()[:12])
    paths = {name: f"{base}/{name}" for name in binding.RAW_COLUMNS}
    for name, columns in binding.RAW_COLUMNS.items():
        files.write_csv(getattr(raw, name).select(*columns), paths[name])
    tables = M.clean_tables(binding.load_raw(spark, paths))
    files.write_checkpoint(M.build_master(tables, MissingPolicy()), f"{base}/master")
    master = files.read_checkpoint(spark, f"{base}/master")
    M.verify_merge(tables, master)
    return master


@query("clean_names", O.ctes() + "select * from census_raw")
def q_clean_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers as they appear in the raw files -> snake_case names."""
    raw = binding.census_raw(spark, sf_dir)
    messy = raw.toDF("DOT Number", "NbrPowerUnit", "Driver Total", "Carrier-Operation",
                     "HM_Flag", "PC Flag ", "DBA Name", "Phy.State")
    return files.clean_names(messy)


@query("shape_report", O.ctes() + """
select 'census' as "table", count(*) as n_rows, 8 as n_cols from census_raw union all
select 'inspection', count(*), 20 from inspection_raw union all
select 'violation', count(*), 2 from violation_raw union all
select 'crash', count(*), 8 from crash_raw""")
def q_shape_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = binding.bind(spark, sf_dir)
    return files.shape_report({"census": raw.census, "inspection": raw.inspection,
                               "violation": raw.violation, "crash": raw.crash})


@query("master_checkpoint", with_master(_master_select()))
def q_master_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S4 + S5: the master written as Parquet and read back."""
    return M.master_for(spark, sf_dir)


# ---------------------------------------------------------------- scalar cleaning
@query("clean_key", with_master("""
select unique_id, dot_number from inspection"""))
def q_clean_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.load_clean(spark, sf_dir).inspection.select("unique_id", "dot_number")


@query("clean_category", O.ctes() + f"""
select {O.trim('dot_number')} as dot_number, upper({O.trim('carrier_operation')}) as carrier_operation
from census_raw""")
def q_clean_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = binding.census_raw(spark, sf_dir)
    return raw.select(S.clean_key("dot_number").alias("dot_number"),
                      S.clean_category("carrier_operation").alias("carrier_operation"))


@query("to_num", O.ctes() + f"""
select dot_number, try_cast({O.trim("cast(driver_total as varchar)")} as double) as driver_total_num,
  try_cast({O.trim('hm_flag')} as double) as hm_flag_num
from census_raw""")
def q_to_num(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = binding.census_raw(spark, sf_dir)
    return raw.select("dot_number", S.to_num(F.col("driver_total").cast("string")).alias("driver_total_num"),
                      S.to_num("hm_flag").alias("hm_flag_num"))


@query("yn_flag", O.ctes() + f"""
select dot_number, hm_flag as hm_flag_raw, {O.yn('hm_flag')} as hm_flag, {O.yn('pc_flag')} as pc_flag
from census_raw""")
def q_yn_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = binding.census_raw(spark, sf_dir)
    return raw.select("dot_number", F.col("hm_flag").alias("hm_flag_raw"),
                      S.yn_flag("hm_flag").alias("hm_flag"), S.yn_flag("pc_flag").alias("pc_flag"))


@query("tri_bool", O.ctes() + f"""
select dot_number, {O.tri('hm_flag')} as hm_flag_tri, {O.tri('pc_flag')} as pc_flag_tri from census_raw""")
def q_tri_bool(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = binding.census_raw(spark, sf_dir)
    return raw.select("dot_number", S.tri_bool("hm_flag").alias("hm_flag_tri"),
                      S.tri_bool("pc_flag").alias("pc_flag_tri"))


@query("to_date_safe", O.ctes() + """
select unique_id,
  cast(cast(coalesce(try_strptime(strftime(insp_date, '%Y%m%d'), '%Y%m%d'),
                try_strptime(strftime(insp_date, '%Y%m%d'), '%Y-%m-%d')) as date) as varchar) as d_compact,
  cast(cast(coalesce(try_strptime(cast(insp_date as varchar), '%Y%m%d'),
                try_strptime(cast(insp_date as varchar), '%Y-%m-%d')) as date) as varchar) as d_iso,
  cast(null as varchar) as d_bad
from inspection_raw""")
def q_to_date_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = binding.inspection_raw(spark, sf_dir)
    return raw.select(
        "unique_id",
        S.to_date_safe(F.date_format("insp_date", "yyyyMMdd")).alias("d_compact"),
        S.to_date_safe(F.col("insp_date").cast("string")).alias("d_iso"),
        S.to_date_safe(F.concat(F.col("unique_id"), F.lit("-bad"))).alias("d_bad"))


@query("safe_div", with_master(f"""
select dot_number, {r6(O.safe_div('driver_total', 'nbr_power_unit'))} as drivers_per_unit,
  {r6(O.safe_div('sum_oos_total', 'total_inspections'))} as oos_rate,
  {r6(O.safe_div('total_fatalities', 'total_crashes'))} as fatal_crash_rate
from merged"""))
def q_safe_div(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P7 on the merged frame before imputation (NULL and 0 denominators present)."""
    m = M.merged_master(M.load_clean(spark, sf_dir))
    return m.select("dot_number",
                    S.safe_div("driver_total", "nbr_power_unit").alias("drivers_per_unit"),
                    S.safe_div("sum_oos_total", "total_inspections").alias("oos_rate"),
                    S.safe_div("total_fatalities", "total_crashes").alias("fatal_crash_rate"))


@query("raw_viol_per_insp", with_master(f"""
select dot_number, {r6('raw_viol_per_insp')} as raw_viol_per_insp from rv"""))
def q_raw_viol_per_insp(spark: SparkSession, sf_dir: str) -> DataFrame:
    rv = features.report_view(M.master_for(spark, sf_dir))
    return rv.select("dot_number", "raw_viol_per_insp")


@query("log1p_floor", with_master(f"""
select dot_number, {r6('ln(1 + greatest(nbr_power_unit, 0.0))')} as fleet_size_log,
  {r6('ln(1 + greatest(driver_total, 0.0))')} as log_driver_total,
  {r6('ln(1 + greatest(total_crashes, 0.0))')} as log_total_crashes
from merged"""))
def q_log1p_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P9 before imputation: NULL counts as 0."""
    m = M.merged_master(M.load_clean(spark, sf_dir))
    return m.select("dot_number", S.log1p_floor("nbr_power_unit").alias("fleet_size_log"),
                    S.log1p_floor("driver_total").alias("log_driver_total"),
                    S.log1p_floor("total_crashes").alias("log_total_crashes"))


@query("log1p_roundtrip", with_master(f"""
select dot_number, {r6('ln(1 + sum_severity_weight)')} as log_severity,
  {r6('exp(ln(1 + sum_severity_weight)) - 1')} as severity_back
from master"""))
def q_log1p_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = M.master_for(spark, sf_dir)
    lg = S.log1p_plain("sum_severity_weight")
    return m.select("dot_number", lg.alias("log_severity"), S.expm1_plain(lg).alias("severity_back"))


@query("violation_intensity", with_master(f"""
select dot_number, {r6('violation_intensity_score')} as violation_intensity_score from master"""))
def q_violation_intensity(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = M.master_for(spark, sf_dir)
    return m.select("dot_number", S.weighted_score(features.VIOLATION_WEIGHTS).alias("violation_intensity_score"))


@query("op_dummies", with_master("""
select dot_number, carrier_operation, is_interstate, is_intra_hazmat, is_intra_nonhaz from master"""))
def q_op_dummies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.master_for(spark, sf_dir).select("dot_number", "carrier_operation", "is_interstate",
                                              "is_intra_hazmat", "is_intra_nonhaz")


@query("target_flag", with_master(f"""
select dot_number, {r6('sum_oos_total')} as sum_oos_total, oos_flag from master"""))
def q_target_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = M.master_for(spark, sf_dir)
    return m.select("dot_number", "sum_oos_total", S.binary_label("sum_oos_total").alias("oos_flag"))


# ---------------------------------------------------------------- filters
@query("filter_keys", O.ctes() + f"""
select 'census' as tbl, count(*) as n_kept from census_raw
  where {O.trim('dot_number')} is not null and {O.trim('dot_number')} <> '' union all
select 'inspection', count(*) from inspection union all
select 'violation', count(*) from violation union all
select 'crash', count(*) from crash_all""")
def q_filter_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = binding.bind(spark, sf_dir)
    parts = {
        "census": clean.filter_keys(raw.census.withColumn("dot_number", S.clean_key("dot_number")), "dot_number"),
        "inspection": clean.clean_inspection(raw.inspection),
        "violation": clean.clean_violation(raw.violation),
        "crash": clean.clean_crash(raw.crash, apply_exclusion=False),
    }
    out = None
    for name, df in parts.items():
        one = df.agg(F.count(F.lit(1)).alias("n_kept")).select(F.lit(name).alias("tbl"), "n_kept")
        out = one if out is None else out.unionByName(one)
    return out


@query("crash_exclusion", with_master(f"""
select dot_number, cast(report_date as varchar) as report_date, {r6('fatalities')} as fatalities,
  {r6('injuries')} as injuries, {r6('severity_weight')} as severity_weight, tow_away, hazmat_released
from crash"""))
def q_crash_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = M.load_clean(spark, sf_dir).crash
    return c.select("dot_number", "report_date", "fatalities", "injuries", "severity_weight",
                    "tow_away", "hazmat_released")


@query("inspected_universe", with_master("""
select dot_number, total_inspections, oos_flag from master where total_inspections >= 1"""))
def q_inspected_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.inspected_universe(M.master_for(spark, sf_dir)).select("dot_number", "total_inspections", "oos_flag")


@query("dedupe_keep_first", O.ctes([("census_dup", f"""
select *, 0 as src_order from census_raw union all
select * replace ('DUP-' || phy_state as phy_state), 1 as src_order from census_raw
  where cast({O.trim('dot_number')} as bigint) % 97 = 0""")]) + f"""
select {O.trim('dot_number')} as dot_number, phy_state, nbr_power_unit
from census_dup qualify row_number() over (partition by {O.trim('dot_number')} order by src_order) = 1""")
def q_dedupe_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N12 on the census plus planted duplicates (another state): first row wins."""
    raw = binding.census_raw(spark, sf_dir)
    dup = (raw.where(S.clean_key("dot_number").cast("long") % 97 == 0)
           .withColumn("phy_state", F.concat(F.lit("DUP-"), F.col("phy_state"))))
    both = raw.withColumn("src_order", F.lit(0)).unionByName(dup.withColumn("src_order", F.lit(1)))
    both = both.withColumn("dot_number", S.clean_key("dot_number"))
    kept = clean.dedupe_keep_first(both.select("dot_number", "phy_state", "nbr_power_unit", "src_order"),
                                   "dot_number", order="src_order")
    return kept.select("dot_number", "phy_state", "nbr_power_unit")


# ---------------------------------------------------------------- rollups and joins
@query("insp_agg", with_master(
    "select * replace (" + ", ".join(
        [f"{r6(o)} as {o}" for o, s in rollup.INSPECTION_SUMS.items() if not s.endswith("_insp")]
        + ["cast(last_inspection as varchar) as last_inspection"]) + ") from insp_agg"))
def q_insp_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.insp_agg(M.load_clean(spark, sf_dir).inspection)


@query("bridge_join", with_master("select inspection_id, out_of_service_flag, dot_number from viol_bridge"))
def q_bridge_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = M.load_clean(spark, sf_dir)
    return rollup.bridge_join(t.violation, t.inspection).select("inspection_id", "out_of_service_flag", "dot_number")


@query("viol_agg", with_master("select * from viol_agg"))
def q_viol_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = M.load_clean(spark, sf_dir)
    return rollup.viol_agg(t.violation, t.inspection)


@query("crash_agg", with_master(
    "select * replace (" + ", ".join(f"{r6(c)} as {c}" for c in
                                     ("total_fatalities", "total_injuries", "sum_severity_weight"))
    + ") from crash_agg"))
def q_crash_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.crash_agg(M.load_clean(spark, sf_dir).crash)


_MERGED_DOUBLES = ["nbr_power_unit", "driver_total"] + [
    c for c in MASTER_DOUBLES if c in rollup.INSPECTION_SUMS or c in
    ("total_fatalities", "total_injuries", "sum_severity_weight")]


@query("master_merge", with_master(
    "select * replace (" + ", ".join([f"{r6(c)} as {c}" for c in _MERGED_DOUBLES]
                                     + ["cast(last_inspection as varchar) as last_inspection"]) + ") from merged"))
def q_master_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J2 + N5 with the fused rollup (A1+A2 in one aggregate)."""
    return M.merged_master(M.load_clean(spark, sf_dir))


@query("impute_zero", with_master(
    "select dot_number, " + ", ".join(
        (r6(c) + f" as {c}") if c in _MERGED_DOUBLES else c for c in rollup.ZERO_FILL) + " from merged"))
def q_impute_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = M.load_clean(spark, sf_dir)
    merged = (t.census.join(rollup.insp_agg(t.inspection), "dot_number", "left")
              .join(rollup.viol_agg(t.violation, t.inspection), "dot_number", "left")
              .join(rollup.crash_agg(t.crash), "dot_number", "left"))
    return rollup.zero_fill(merged).select("dot_number", *rollup.ZERO_FILL)


@query("impute_median", with_master(f"""
select m.dot_number, {r6('coalesce(m.nbr_power_unit, md.m_npu)')} as nbr_power_unit,
  {r6('coalesce(m.driver_total, md.m_dt)')} as driver_total
from merged m, medians md"""))
def q_impute_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = M.merged_master(M.load_clean(spark, sf_dir))
    return impute_median(merged, fit_medians(merged)).select("dot_number", "nbr_power_unit", "driver_total")


@query("impute_unknown", with_master("select dot_number, coalesce(dba_name, 'UNKNOWN') as dba_name from merged"))
def q_impute_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = M.merged_master(M.load_clean(spark, sf_dir))
    return impute_unknown(merged).select("dot_number", "dba_name")


@query("drop_missing_geo", with_master("select dot_number, phy_state from merged where phy_state is not null"))
def q_drop_missing_geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = M.merged_master(M.load_clean(spark, sf_dir))
    return drop_missing_geo(merged).select("dot_number", "phy_state")


@query("merge_integrity", with_master("""
select 'census_rows' as "check", (select count(*) from census) as value union all
select 'master_rows', (select count(*) from merged) union all
select 'duplicate_unique_ids', (select count(*) from (select unique_id from inspection group by unique_id having count(*) > 1)) union all
select 'merge_ok', cast((select count(*) from census) = (select count(*) from merged) as bigint)"""))
def q_merge_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = M.load_clean(spark, sf_dir)
    merged = M.merged_master(t)
    return rollup.merge_integrity(t.census, merged, t.inspection)


@query("policy_master", with_master(_master_select()))
def q_policy_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N5-N8 via the MissingPolicy object + features + target, without the checkpoint."""
    return M.build_master(M.load_clean(spark, sf_dir), MissingPolicy())
