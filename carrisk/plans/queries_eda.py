"""Registered queries: the named report datasets (§2.11) and the operators they use."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carrisk.functions import scalar as S
from carrisk.operators import aggregates as A
from carrisk.operators import clean, dist, rank
from carrisk.operators.features import report_view
from carrisk.plans import master as M
from carrisk.plans.oracle import r6, with_master
from carrisk.plans.registry import query

# OOS-rate bucket edges and labels, BASIC group labels.
OOS_BREAKS = (-0.01, 0.0, 0.1, 0.25, 0.5, 1.01)
OOS_LABELS = ("0%", "0-10%", "10-25%", "25-50%", ">50%")
BASIC_VIOL = {
    "Unsafe Driving": "viol_unsafe",
    "Hours-of-Service": "viol_fatigued",
    "Driver Fitness": "viol_dr_fitness",
    "Substance/Alcohol": "viol_subt_alcohol",
    "Vehicle Maint.": "viol_vh_maint",
    "HM Compliance": "viol_hm",
}
BASIC_INSP = {
    "Unsafe Driving": "insp_unsafe",
    "Hours-of-Service": "insp_fatigued",
    "Driver Fitness": "insp_dr_fitness",
    "Substance/Alcohol": "insp_subt_alcohol",
    "Vehicle Maint.": "insp_vh_maint",
    "HM Compliance": "insp_hm",
}
OOS_KIND = {"Driver OOS": "sum_driver_oos", "Vehicle OOS": "sum_vehicle_oos", "Hazmat OOS": "sum_hazmat_oos"}
CORR_COLUMNS = ("nbr_power_unit", "driver_total", "recent_mileage", "total_inspections", "sum_oos_total",
                "sum_basic_viol", "violation_intensity_score", "total_crashes", "total_fatalities",
                "sum_severity_weight", "oos_rate", "crash_to_inspection_ratio")
CORRPLOT_COLUMNS = ("nbr_power_unit", "driver_total", "total_inspections", "oos_rate",
                    "violation_intensity_score", "crash_to_inspection_ratio", "total_crashes",
                    "total_fatalities", "sum_severity_weight")
NEEDED_COLUMNS = (
    "nbr_power_unit", "driver_total", "carrier_operation", "hm_flag_lgl", "phy_state", "total_inspections",
    "sum_oos_total", "sum_basic_viol", "sum_driver_oos", "sum_vehicle_oos", "sum_hazmat_oos", "viol_unsafe",
    "viol_fatigued", "viol_dr_fitness", "viol_subt_alcohol", "viol_vh_maint", "viol_hm", "insp_unsafe",
    "insp_fatigued", "insp_dr_fitness", "insp_subt_alcohol", "insp_vh_maint", "insp_hm", "total_crashes",
    "total_fatalities", "total_injuries", "sum_severity_weight", "total_hazmat_release", "oos_rate",
    "violation_intensity_score", "crash_to_inspection_ratio", "oos_flag")
SUMMARY_COLUMNS = ("nbr_power_unit", "driver_total", "total_inspections", "sum_oos_total", "oos_rate",
                   "violation_intensity_score", "crash_to_inspection_ratio", "total_crashes", "sum_severity_weight")
QUANTILE_PROBS = (0.0, 1 / 3, 2 / 3, 1.0, 0.99, 0.995, 0.999)


def rv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report_view(M.master_for(spark, sf_dir))


def inspected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rv(spark, sf_dir).where(F.col("has_inspection"))


def _dbl(v: float) -> str:
    return f"cast({v!r} as double)"


# ------------------------------------------------------------------ A: universe
@query("oos_share_by_operation", with_master(f"""
select carrier_operation, {r6("avg(case when oos_flag = 'OOS' then 1.0 else 0.0 end)")} as oos_share,
  count(*) as n
from rv where has_inspection group by carrier_operation"""))
def q_oos_share_by_operation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minimum slice: share of inspected carriers with any OOS, by operation."""
    return A.grouped_share(inspected(spark, sf_dir), ["carrier_operation"], F.col("oos_flag") == "OOS", "oos_share")


@query("freq_count", with_master("select carrier_operation, count(*) as n from rv group by carrier_operation"))
def q_freq_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: carriers by operation (NULL is a group)."""
    return A.freq_count(rv(spark, sf_dir), "carrier_operation")


@query("stack_labelled", with_master("""
select carrier_operation, count(*) as n, 'Hazmat' as Type from rv where hm_flag_lgl group by carrier_operation
union all
select carrier_operation, count(*) as n, 'Passenger' as Type from rv where pc_flag_lgl group by carrier_operation"""))
def q_stack_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: hazmat and passenger carriers by operation, stacked with a label."""
    df = rv(spark, sf_dir)
    return A.stack_labelled({
        "Hazmat": A.freq_count(df.where(F.col("hm_flag_lgl")), "carrier_operation"),
        "Passenger": A.freq_count(df.where(F.col("pc_flag_lgl")), "carrier_operation"),
    }, label="Type")


def _hist_sql(x_expr: str, where: str, bins: int) -> str:
    return with_master(f"""
select cast(b as integer) as bin, {r6('lo + b*w')} as x_mid, {r6('(lo - w/2) + b*w')} as x_lo,
  {r6('(lo - w/2) + (b+1)*w')} as x_hi, count(*) as n
from (select greatest(ceil((x - (lo - w/2))/w) - 1, 0) as b, lo, w from hx, hp)
group by b, lo, w""", [
        ("hx", f"select {x_expr} as x from rv where {where}"),
        ("hr", "select min(x) as lo, max(x) as hi from hx"),
        ("hp", f"select lo, case when hi > lo then (hi - lo)/{bins - 1} else 1.0 end as w from hr"),
    ])


@query("histogram_log10", _hist_sql("log10(cast(nbr_power_unit as double))",
                                    "nbr_power_unit > 0 and not isnan(nbr_power_unit)", 60))
def q_histogram_log10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: fleet size histogram, 60 bins on a log10 axis."""
    df = rv(spark, sf_dir).where(F.col("nbr_power_unit") > 0)
    return dist.histogram(df, "nbr_power_unit", bins=60, log10=True)


@query("histogram_linear", _hist_sql("cast(drivers_per_unit as double)",
                                     "drivers_per_unit > 0 and drivers_per_unit < 10", 60))
def q_histogram_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: drivers per power unit in (0, 10), 60 bins."""
    df = rv(spark, sf_dir).where((F.col("drivers_per_unit") > 0) & (F.col("drivers_per_unit") < 10))
    return dist.histogram(df, "drivers_per_unit", bins=60)


# ------------------------------------------------------------------ B1: target
def _cut_sql(col: str) -> str:
    parts = []
    for i, label in enumerate(OOS_LABELS):
        lo, hi = OOS_BREAKS[i], OOS_BREAKS[i + 1]
        parts.append(f"when {col} > {_dbl(lo)} and {col} <= {_dbl(hi)} then '{label}'")
    return "case " + " ".join(parts) + " end"


@query("cut_buckets", with_master(f"""
select oos_bucket, n, {r6('n / sum(n) over ()')} as pct from (
  select {_cut_sql('oos_rate')} as oos_bucket, count(*) as n from rv where has_inspection group by 1
) where oos_bucket is not null"""))
def q_cut_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OOS-rate buckets (right-closed); rates above 1.01 fall out before the share."""
    df = inspected(spark, sf_dir).withColumn("oos_bucket", S.cut("oos_rate", OOS_BREAKS, OOS_LABELS))
    counts = A.freq_count(df, "oos_bucket").where(F.col("oos_bucket").isNotNull())
    return A.share_within(counts, "n")


@query("class_balance", with_master(f"""
select oos_flag, count(*) as n, {r6('count(*) / sum(count(*)) over ()')} as pct
from rv where has_inspection group by oos_flag"""))
def q_class_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class balance of the target among inspected carriers."""
    return A.class_balance(inspected(spark, sf_dir), "oos_flag")


@query("format_report", with_master("""
select oos_flag, format('{:,}', count(*)) || ' (' || printf('%.1f', 100.0 * count(*) / sum(count(*)) over ()) || '%)'
  as label
from rv where has_inspection group by oos_flag"""))
def q_format_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P21: "n (pct)" label text of the class balance."""
    bal = A.class_balance(inspected(spark, sf_dir), "oos_flag")
    return bal.select("oos_flag", F.concat(S.comma_text("n"), F.lit(" ("), S.pct_text("pct", 1), F.lit(")"))
                      .alias("label"))


def _box_sql(x_expr: str, where: str, keys: list[str], source: str = "rv") -> str:
    k = ", ".join(keys)
    kc = (k + ", ") if keys else ""
    on = " and ".join(f"bx.{c} is not distinct from bq.{c}" for c in keys) or "true"
    return with_master(f"""
select {', '.join(f'bq.{c}' for c in keys) + ', ' if keys else ''}bq.n, {r6('bq.q1')} as q1, {r6('bq.median')} as median,
  {r6('bq.q3')} as q3, {r6('min(case when bx.x >= bq.q1 - 1.5*(bq.q3-bq.q1) then bx.x end)')} as whisker_lo,
  {r6('max(case when bx.x <= bq.q3 + 1.5*(bq.q3-bq.q1) then bx.x end)')} as whisker_hi,
  count(case when bx.x < bq.q1 - 1.5*(bq.q3-bq.q1) or bx.x > bq.q3 + 1.5*(bq.q3-bq.q1) then 1 end) as n_outliers
from bx join bq on {on}
group by {', '.join(f'bq.{c}' for c in keys) + ', ' if keys else ''}bq.n, bq.q1, bq.median, bq.q3""", [
        ("bx", f"select {kc}{x_expr} as x from {source} where {where}"),
        ("bq", f"""select {kc}count(*) as n, quantile_cont(x, 0.25) as q1, quantile_cont(x, 0.5) as median,
  quantile_cont(x, 0.75) as q3 from bx {'group by ' + k if keys else ''}"""),
    ])


@query("box_stats", _box_sql("cast(oos_rate as double)", "has_inspection and oos_rate > 0 and not isnan(oos_rate)",
                             ["carrier_operation"]))
def q_box_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OOS rate (> 0) box statistics by operation."""
    df = inspected(spark, sf_dir).where(F.col("oos_rate") > 0)
    return dist.box_stats(df, "oos_rate", ["carrier_operation"])


@query("grouped_share", with_master(f"""
select HM_Status, {r6("avg(case when oos_flag = 'OOS' then 1.0 else 0.0 end)")} as oos_share, count(*) as n
from rv where has_inspection group by HM_Status"""))
def q_grouped_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1d: OOS share by hazmat status."""
    return A.grouped_share(inspected(spark, sf_dir), ["HM_Status"], F.col("oos_flag") == "OOS", "oos_share")


# ------------------------------------------------------------------ B2: densities
def _kde_sql(x_expr: str, where: str, keys, grid: int = 512, fine: int = 2048,
             grid_range: tuple[float, float] | None = None, source: tuple[str, str] | None = None) -> str:
    keys = [keys] if isinstance(keys, str) else list(keys)
    inv = 1.0 / math.sqrt(2 * math.pi)
    kl = ", ".join(keys)
    on = " and ".join(f"kb.{k} is not distinct from kw.{k}" for k in keys)
    kr = ("select min(lo) as lo, max(hi) as hi from ks" if grid_range is None
          else f"select {_dbl(grid_range[0])} as lo, {_dbl(grid_range[1])} as hi")
    return with_master(f"""
select {', '.join(f'kb.{k}' for k in keys)}, {r6('kp.lo + g.i * kp.step')} as x,
  {r6(f'sum(kb.c * exp(-0.5 * pow(((kp.lo + g.i * kp.step) - (kp.lo + (kb.b + 0.5) * kp.fw)) / kw.bw, 2))) * {inv!r} / (kw.n * kw.bw)')} as density,
  kw.n, {r6('kw.bw')} as bw
from kb join kw on {on}
  cross join kp cross join (select range as i from range({grid})) g
group by {', '.join(f'kb.{k}' for k in keys)}, g.i, kp.lo, kp.step, kw.n, kw.bw""", [
        *([source] if source else []),
        ("kx", f"select {kl}, {x_expr} as x from {source[0] if source else 'rv'} where {where}"),
        ("ks", f"""select {kl}, count(*) as n, coalesce(stddev_samp(x), 0.0) as sd,
  quantile_cont(x, 0.25) as q1, quantile_cont(x, 0.75) as q3, min(x) as lo, max(x) as hi from kx group by {kl}"""),
        ("kr", kr),
        ("kp", f"""select lo, (case when hi > lo then hi - lo else 1.0 end) / {fine} as fw,
  (case when hi > lo then hi - lo else 1.0 end) / {grid - 1} as step from kr"""),
        ("kw", f"""select {kl}, n, 0.9 * (case when least(sd, (q3 - q1) / 1.34) <> 0 then least(sd, (q3 - q1) / 1.34)
  when sd <> 0 then sd when abs(lo) <> 0 then abs(lo) else 1.0 end) * pow(n, -0.2) as bw from ks"""),
        ("kb", f"""select {kl}, cast(least(floor((x - kp.lo) / kp.fw), {fine - 1}) as integer) as b, count(*) as c
  from kx cross join kp group by {kl}, {len(keys) + 1}"""),
    ])


@query("kde_by_group", _kde_sql("cast(oos_rate as double)",
                                "has_inspection and oos_rate >= 0 and oos_rate <= 1", "oos_flag", grid_range=(0.0, 1.0)))
def q_kde_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Density of the OOS rate by class on the axis limits [0, 1] (rates above 1 leave
    before the statistic), 512-point grid, nrd0 bandwidth."""
    return dist.kde(inspected(spark, sf_dir), "oos_rate", ["oos_flag"], keep_between=(0.0, 1.0))


@query("kde_crash_ratio", _kde_sql("cast(crash_to_inspection_ratio as double)",
                                   "has_inspection and crash_to_inspection_ratio > 0 and crash_to_inspection_ratio < 1",
                                   "HM_Status"))
def q_kde_crash_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Density of crashes per inspection in (0, 1) by hazmat status."""
    df = inspected(spark, sf_dir).where((F.col("crash_to_inspection_ratio") > 0)
                                        & (F.col("crash_to_inspection_ratio") < 1))
    return dist.kde(df, "crash_to_inspection_ratio", ["HM_Status"])


@query("kde_crash_by_class", _kde_sql("cast(crash_to_inspection_ratio as double)",
                                      "has_inspection and crash_to_inspection_ratio < 1", "oos_flag"))
def q_kde_crash_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Density of crashes per inspection (< 1) by class."""
    df = inspected(spark, sf_dir).where(F.col("crash_to_inspection_ratio") < 1)
    return dist.kde(df, "crash_to_inspection_ratio", ["oos_flag"])


@query("kde_intensity", _kde_sql("log10(violation_intensity_score)",
                                 "has_inspection and violation_intensity_score > 0", "oos_flag"))
def q_kde_intensity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B2c / B2d (engineered panel): density of the violation intensity score on a log10 axis by class."""
    df = inspected(spark, sf_dir).where(F.col("violation_intensity_score") > 0)
    return dist.kde(df, "violation_intensity_score", ["oos_flag"], log10=True)


@query("kde_raw_viol", _kde_sql("cast(raw_viol_per_insp as double)",
                                "has_inspection and raw_viol_per_insp > 0 and raw_viol_per_insp < 30", "oos_flag"))
def q_kde_raw_viol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B2d (raw panel): density of raw violations per inspection in (0, 30) by class."""
    df = inspected(spark, sf_dir).where((F.col("raw_viol_per_insp") > 0) & (F.col("raw_viol_per_insp") < 30))
    return dist.kde(df, "raw_viol_per_insp", ["oos_flag"])


@query("kde_oos_ridges", _kde_sql("cast(oos_rate as double)", "has_inspection and oos_rate > 0 and oos_rate <= 1",
                                  ["carrier_operation", "HM_Status"]))
def q_kde_oos_ridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OOS-rate (> 0, axis limit 1) density per operation x hazmat status."""
    df = inspected(spark, sf_dir).where(F.col("oos_rate") > 0)
    return dist.kde(df, "oos_rate", ["carrier_operation", "HM_Status"], keep_between=(None, 1.0))


@query("range_filters", with_master(f"""
select dot_number, {r6('violation_intensity_score')} as violation_intensity_score,
  {r6('crash_to_inspection_ratio')} as crash_to_inspection_ratio
from rv where has_inspection and violation_intensity_score > 0
  and crash_to_inspection_ratio > 0 and crash_to_inspection_ratio < 1"""))
def q_range_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conjunctive open-interval filter behind the joint intensity/crash plot (B2e)."""
    df = inspected(spark, sf_dir).where(
        (F.col("violation_intensity_score") > 0) & F.col("crash_to_inspection_ratio").between(0, 1)
        & (F.col("crash_to_inspection_ratio") > 0) & (F.col("crash_to_inspection_ratio") < 1))
    return df.select("dot_number", "violation_intensity_score", "crash_to_inspection_ratio")


# ------------------------------------------------------------------ B3: composition
@query("heat_table", with_master(f"""
select carrier_operation, HM_Status, OOS_Category, {r6('Average_Violations')} as Average_Violations from (
  select carrier_operation, HM_Status, avg(sum_driver_oos) as "Driver OOS", avg(sum_vehicle_oos) as "Vehicle OOS",
    avg(sum_hazmat_oos) as "Hazmat OOS" from rv where has_inspection group by carrier_operation, HM_Status
) unpivot (Average_Violations for OOS_Category in ("Driver OOS", "Vehicle OOS", "Hazmat OOS"))"""))
def q_heat_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean OOS counts by operation x hazmat status, long."""
    means = A.grouped_means(inspected(spark, sf_dir), ["carrier_operation", "HM_Status"], OOS_KIND)
    return A.unpivot_long(means, ["carrier_operation", "HM_Status"], list(OOS_KIND), "OOS_Category",
                          "Average_Violations")


@query("share_within", with_master(f"""
select carrier_operation, Category, {r6('n')} as n, {r6('n / sum(n) over (partition by carrier_operation)')} as share
from (select carrier_operation, coalesce(sum(sum_driver_oos), 0) as Driver, coalesce(sum(sum_vehicle_oos), 0) as Vehicle,
        coalesce(sum(sum_hazmat_oos), 0) as Hazmat from rv group by carrier_operation)
unpivot (n for Category in (Driver, Vehicle, Hazmat))"""))
def q_share_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composition of OOS counts by kind within each operation."""
    sums = A.group_sums(rv(spark, sf_dir), ["carrier_operation"],
                        {"Driver": "sum_driver_oos", "Vehicle": "sum_vehicle_oos", "Hazmat": "sum_hazmat_oos"})
    long = A.unpivot_long(sums, ["carrier_operation"], ["Driver", "Vehicle", "Hazmat"], "Category", "n")
    return A.share_within(long, "n", ["carrier_operation"], "share")


@query("unpivot_long", with_master(f"""
select carrier_operation, BASIC, {r6('avg(cast(covered as double))')} as coverage from (
  select carrier_operation, {', '.join(f'{c} > 0 as "{k}"' for k, c in BASIC_INSP.items())}
  from rv where has_inspection
) unpivot (covered for BASIC in ({', '.join(f'"{k}"' for k in BASIC_INSP)}))
group by carrier_operation, BASIC"""))
def q_unpivot_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of inspected carriers with any inspection in each BASIC, by operation."""
    df = inspected(spark, sf_dir).select("carrier_operation",
                                         *[(F.col(c) > 0).alias(k) for k, c in BASIC_INSP.items()])
    long = A.unpivot_long(df, ["carrier_operation"], list(BASIC_INSP), "BASIC", "covered")
    return long.groupBy("carrier_operation", "BASIC").agg(F.avg("covered").alias("coverage"))


def _violin_long(spark, sf_dir) -> DataFrame:
    df = inspected(spark, sf_dir).select("oos_flag", *[F.col(c).alias(k) for k, c in BASIC_VIOL.items()])
    return A.unpivot_long(df, ["oos_flag"], list(BASIC_VIOL), "BASIC", "viol").where(F.col("viol") > 0)


_VIOLIN_SRC = ("vl", f"""select oos_flag, BASIC, viol from (
  select oos_flag, {', '.join(f'cast({c} as double) as "{k}"' for k, c in BASIC_VIOL.items())} from rv where has_inspection
) unpivot (viol for BASIC in ({', '.join(f'"{k}"' for k in BASIC_VIOL)})) where viol > 0""")


def _box_from(source_cte: tuple[str, str], x_expr: str, keys: list[str]) -> str:
    sql = _box_sql(x_expr, "true", keys, source=source_cte[0])
    # splice the source CTE in front of bx
    return sql.replace("with census_raw as", "with census_raw as", 1).replace(
        "bx as (", f"{source_cte[0]} as ({source_cte[1]}\n),\nbx as (", 1)


@query("violin_stats", _box_from(_VIOLIN_SRC, "log10(viol)", ["oos_flag", "BASIC"]))
def q_violin_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B3d: violations per BASIC by class, box statistics on the log10 axis (violin body via kde)."""
    return dist.box_stats(_violin_long(spark, sf_dir), "viol", ["oos_flag", "BASIC"], log10=True)


@query("violin_density", _kde_sql("log10(viol)", "true", ["oos_flag", "BASIC"], source=_VIOLIN_SRC))
def q_violin_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B3d: the violins' bodies, density of log10 violations per BASIC by class."""
    return dist.kde(_violin_long(spark, sf_dir), "viol", ["oos_flag", "BASIC"], log10=True)


B4B_FEATURES = ("nbr_power_unit", "driver_total", "total_inspections", "sum_basic_viol", "total_crashes",
                "violation_intensity_score")
_B4B_SRC = ("fl", f"""select oos_flag, feature, value from (
  select oos_flag, {', '.join(f'cast({c} as double) as {c}' for c in B4B_FEATURES)} from rv where has_inspection
) unpivot (value for feature in ({', '.join(B4B_FEATURES)})) where value > 0""")


@query("box_features_by_class", _box_from(_B4B_SRC, "log10(value)", ["oos_flag", "feature"]))
def q_box_features_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six carrier features (> 0) by class, box statistics on the log10 axis."""
    df = inspected(spark, sf_dir).select("oos_flag", *B4B_FEATURES)
    long = A.unpivot_long(df, ["oos_flag"], list(B4B_FEATURES), "feature", "value").where(F.col("value") > 0)
    return dist.box_stats(long, "value", ["oos_flag", "feature"], log10=True)


@query("feature_density", _kde_sql("log10(value)", "true", ["oos_flag", "feature"], source=_B4B_SRC))
def q_feature_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The violins' bodies, density of log10 of six carrier features by class."""
    df = inspected(spark, sf_dir).select("oos_flag", *B4B_FEATURES)
    long = A.unpivot_long(df, ["oos_flag"], list(B4B_FEATURES), "feature", "value").where(F.col("value") > 0)
    return dist.kde(long, "value", ["oos_flag", "feature"], log10=True)


@query("box_severity_hm", _box_sql("log10(cast(sum_severity_weight as double))", "sum_severity_weight > 0",
                                   ["HM_Status"]))
def q_box_severity_hm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crash severity weight (> 0) by hazmat status, box statistics on the log10 axis."""
    return dist.box_stats(rv(spark, sf_dir).where(F.col("sum_severity_weight") > 0), "sum_severity_weight",
                          ["HM_Status"], log10=True)


def _pca_preview_columns() -> dict:
    return {
        "nbr_power_unit_log": S.log1p_plain("nbr_power_unit"),
        "driver_total_log": S.log1p_plain("driver_total"),
        "oos_rate": F.col("oos_rate"),
        "crash_ratio": F.col("crash_to_inspection_ratio"),
        "severity_log": S.log1p_plain("sum_severity_weight"),
        "fatalities_log": S.log1p_plain("total_fatalities"),
        "intensity_log": S.log1p_plain("violation_intensity_score"),
    }


def pca_preview_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seven z-scored measures (column ``features``) of all inspected carriers without NULLs."""
    from carrisk.operators import segment
    cols = _pca_preview_columns()
    df = inspected(spark, sf_dir).select("dot_number", "HM_Status", *[e.alias(k) for k, e in cols.items()])
    return segment.scaled(clean.drop_na_rows(df), tuple(cols))


@query("pca_preview")
def q_pca_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First two principal components of seven z-scored carrier measures, by hazmat status
    (all inspected carriers instead of a 30k sample)."""
    from carrisk.operators import segment
    proj, _ = segment.pca_projection(pca_preview_frame(spark, sf_dir))
    return proj.select("dot_number", "HM_Status", "PC1", "PC2")


@query("pca_preview_variance")
def q_pca_preview_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variance share of the two components of ``pca_preview``, in percent (its axis labels)."""
    from carrisk.operators import segment
    _, shares = segment.pca_projection(pca_preview_frame(spark, sf_dir))
    return spark.createDataFrame([(f"PC{i + 1}", 100.0 * v) for i, v in enumerate(shares)], "component string, percent double")


@query("drop_na_rows", with_master("""
select dot_number, carrier_operation from rv where carrier_operation is not null and last_inspection is not null"""))
def q_drop_na_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with no NULL in the listed columns (operation code, last inspection date)."""
    return clean.drop_na_rows(rv(spark, sf_dir).select("dot_number", "carrier_operation", "last_inspection"),
                              ["carrier_operation", "last_inspection"]).select("dot_number", "carrier_operation")


# ------------------------------------------------------------------ B4: correlation
def _corr_sql(cols: list[str], source: str, fill_zero: bool) -> str:
    from itertools import combinations
    parts = []
    for a, b in combinations(cols, 2):
        xa = f"coalesce(cast({a} as double), 0.0)" if fill_zero else f"cast({a} as double)"
        xb = f"coalesce(cast({b} as double), 0.0)" if fill_zero else f"cast({b} as double)"
        parts.append(f"select '{a}' as a, '{b}' as b, {r6(f'corr({xa}, {xb})')} as r from {source}")
    return with_master("\nunion all\n".join(parts))


@query("corr_pairwise", _corr_sql([c for c in CORR_COLUMNS if c != "recent_mileage"], "rv", False))
def q_corr_pairwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairwise-complete correlations of the present numeric columns (long)."""
    return A.corr_pairwise(rv(spark, sf_dir), CORR_COLUMNS)


@query("corr_complete", _corr_sql(list(CORRPLOT_COLUMNS), "(select * from rv where total_inspections >= 1)", True))
def q_corr_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation matrix of the modelling universe after the 0-fill."""
    df = clean.inspected_universe(M.master_for(spark, sf_dir))
    return A.corr_complete(df, CORRPLOT_COLUMNS)


# ------------------------------------------------------------------ C: severity, states
@query("loglog_fit", with_master(f"""
select carrier_operation, {r6('case when isnan(regr_slope(ly, lx)) then null else regr_slope(ly, lx) end')} as slope,
  {r6('regr_intercept(ly, lx)')} as intercept, {r6('regr_r2(ly, lx)')} as r2, cast(regr_count(ly, lx) as bigint) as n
from (select carrier_operation, log10(nbr_power_unit) as lx, log10(sum_severity_weight) as ly from rv
      where nbr_power_unit > 0 and total_crashes > 0 and sum_severity_weight > 0)
group by carrier_operation"""))
def q_loglog_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity vs fleet size, straight line on log-log axes per operation."""
    df = rv(spark, sf_dir).where((F.col("nbr_power_unit") > 0) & (F.col("total_crashes") > 0))
    return dist.loglog_fit(df, "nbr_power_unit", "sum_severity_weight", ["carrier_operation"])


@query("bin2d", with_master("""
select cast(least(floor((x - xl) / wx), 49) as integer) as bx, cast(least(floor((y - yl) / wy), 49) as integer) as "by",
  count(*) as n
from (select log10(nbr_power_unit) as x, log10(driver_total) as y from rv where driver_total > 0 and nbr_power_unit > 0) p,
  (select min(log10(nbr_power_unit)) as xl, case when max(log10(nbr_power_unit)) > min(log10(nbr_power_unit))
     then (max(log10(nbr_power_unit)) - min(log10(nbr_power_unit))) / 50 else 1.0 end as wx,
     min(log10(driver_total)) as yl, case when max(log10(driver_total)) > min(log10(driver_total))
     then (max(log10(driver_total)) - min(log10(driver_total))) / 50 else 1.0 end as wy
   from rv where driver_total > 0 and nbr_power_unit > 0) r
group by 1, 2"""))
def q_bin2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drivers vs power units, 50 x 50 bins on log10 axes."""
    df = rv(spark, sf_dir).where((F.col("driver_total") > 0) & (F.col("nbr_power_unit") > 0))
    return dist.bin2d(df, "nbr_power_unit", "driver_total", bins=50, log10=True)


def _hex_sql(points: str, bins: int) -> str:
    """Hexagons of ``points`` (columns x, y): the nearest centre by cube rounding."""
    up = repr(dist.math.sqrt(3.0) / 2.0)
    return with_master(f"""
select cast(hq as bigint) as hq, cast(hr as bigint) as hr, {r6('any_value(ox) + (hq + hr / 2.0) * any_value(wx)')} as x_mid,
  {r6(f'any_value(oy) + hr * {up} * any_value(wy)')} as y_mid, count(*) as n
from (select ox, oy, wx, wy, case when dq > dr and dq > ds then -rr - rs else rq end as hq,
        case when not (dq > dr and dq > ds) and dr > ds then -rq - rs else rr end as hr
      from (select *, abs(rq - q) as dq, abs(rr - r) as dr, abs(rs + q + r) as ds
            from (select *, floor(q + 0.5) as rq, floor(r + 0.5) as rr, floor(0.5 - q - r) as rs
                  from (select *, (x - ox) / wx - r / 2.0 as q
                        from (select *, (y - oy) / wy / {up} as r
                              from hp, (select *, floor(xl / wx) * wx - 1e-6 as ox, floor(yl / wy) * wy - 1e-6 as oy
                                        from (select min(x) as xl, min(y) as yl, case when max(x) > min(x) then (max(x) - min(x)) / {bins} else 1.0 end as wx,
                                                case when max(y) > min(y) then (max(y) - min(y)) / {bins} else 1.0 end as wy from hp)))))))
group by hq, hr""", [("hp", points)])


@query("hex_drivers_units", _hex_sql("""select cast(log10(nbr_power_unit) as double) as x, cast(log10(driver_total) as double) as y
  from rv where driver_total > 0 and nbr_power_unit > 0""", 50))
def q_hex_drivers_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drivers vs power units, hexagons of 1/50 of each log10 axis."""
    df = rv(spark, sf_dir).where((F.col("driver_total") > 0) & (F.col("nbr_power_unit") > 0))
    return dist.hex_bin2d(df, "nbr_power_unit", "driver_total", bins=50, log_x=True, log_y=True)


@query("hex_intensity_crash", _hex_sql("""select cast(log10(violation_intensity_score) as double) as x, cast(crash_to_inspection_ratio as double) as y
  from rv where has_inspection and violation_intensity_score > 0 and crash_to_inspection_ratio > 0 and crash_to_inspection_ratio < 1""", 40))
def q_hex_intensity_crash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B2e: intensity (log10 axis) x crashes per inspection, hexagons of 1/40 of each axis."""
    df = inspected(spark, sf_dir).where((F.col("violation_intensity_score") > 0) & (F.col("crash_to_inspection_ratio") > 0)
                                        & (F.col("crash_to_inspection_ratio") < 1))
    return dist.hex_bin2d(df, "violation_intensity_score", "crash_to_inspection_ratio", bins=40, log_x=True)


@query("trimmed_sample", with_master(f"""
select dot_number, {r6('total_injuries')} as total_injuries, {r6('total_fatalities')} as total_fatalities
from rv, (select quantile_cont(total_injuries, 0.995) as qi, quantile_cont(total_fatalities, 0.999) as qf from rv) q
where total_crashes > 0 and total_injuries >= 0 and total_injuries <= qi
  and total_fatalities >= 0 and total_fatalities <= qf"""))
def q_trimmed_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fatalities vs injuries of carriers with crashes, inside axis limits at the
    99.5th / 99.9th percentiles over all carriers."""
    df = rv(spark, sf_dir)
    lim = dist.quantile_limits(df, {"total_injuries": 0.995, "total_fatalities": 0.999})
    out = dist.trimmed_sample(df.where(F.col("total_crashes") > 0), "dot_number",
                              {c: (0.0, v) for c, v in lim.items()})
    return out.select("dot_number", "total_injuries", "total_fatalities")


@query("risk_axes_rows", with_master(f"""
select dot_number, HM_Status, {r6('oos_rate')} as oos_rate, {r6('crash_to_inspection_ratio')} as crash_to_inspection_ratio
from rv where has_inspection and oos_rate > 0 and crash_to_inspection_ratio > 0 and crash_to_inspection_ratio < 1"""))
def q_risk_axes_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points of the two-risk-axes plot (OOS rate vs crashes per inspection)."""
    df = inspected(spark, sf_dir).where((F.col("oos_rate") > 0) & (F.col("crash_to_inspection_ratio") > 0)
                                        & (F.col("crash_to_inspection_ratio") < 1))
    return df.select("dot_number", "HM_Status", "oos_rate", "crash_to_inspection_ratio")


@query("histogram_severity", _hist_sql("log10(cast(sum_severity_weight as double))", "sum_severity_weight > 0", 60))
def q_histogram_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crash severity weight (> 0), 60 bins on a log10 axis."""
    return dist.histogram(rv(spark, sf_dir).where(F.col("sum_severity_weight") > 0), "sum_severity_weight",
                          bins=60, log10=True)


@query("bin2d_intensity_crash", with_master("""
select cast(least(floor((x - xl) / wx), 39) as integer) as bx, cast(least(floor((y - yl) / wy), 39) as integer) as "by",
  count(*) as n
from (select log10(violation_intensity_score) as x, crash_to_inspection_ratio as y from rv
      where has_inspection and violation_intensity_score > 0 and crash_to_inspection_ratio > 0
        and crash_to_inspection_ratio < 1) p,
  (select min(x) as xl, case when max(x) > min(x) then (max(x) - min(x)) / 40 else 1.0 end as wx,
          min(y) as yl, case when max(y) > min(y) then (max(y) - min(y)) / 40 else 1.0 end as wy
   from (select log10(violation_intensity_score) as x, crash_to_inspection_ratio as y from rv
         where has_inspection and violation_intensity_score > 0 and crash_to_inspection_ratio > 0
           and crash_to_inspection_ratio < 1)) r
group by 1, 2"""))
def q_bin2d_intensity_crash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B2e: intensity (log10 axis) x crashes per inspection, 40 x 40 bins."""
    df = inspected(spark, sf_dir).where((F.col("violation_intensity_score") > 0)
                                        & (F.col("crash_to_inspection_ratio") > 0)
                                        & (F.col("crash_to_inspection_ratio") < 1))
    return dist.bin2d(df, "violation_intensity_score", "crash_to_inspection_ratio", bins=40, log_x=True, log_y=False)


@query("ratio_of_sums", with_master(f"""
select carrier_operation, HM_Status, {r6('sum(cast(total_hazmat_release as double)) / sum(cast(total_crashes as double))')}
  as release_rate, count(*) as n_carriers
from rv where total_crashes > 0 group by carrier_operation, HM_Status"""))
def q_ratio_of_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hazmat release rate = released / crashes, by operation x hazmat status."""
    df = rv(spark, sf_dir).where(F.col("total_crashes") > 0)
    out = A.ratio_of_sums(df, ["carrier_operation", "HM_Status"], "total_hazmat_release", "total_crashes",
                          "release_rate", "n_carriers")
    return out.select("carrier_operation", "HM_Status", "release_rate", "n_carriers")


@query("basic_rate_table", with_master(f"""
select carrier_operation, BASIC, {r6('rate')} as rate from (
  select carrier_operation, {', '.join(f'sum({c}) / sum(total_inspections) as "{k}"' for k, c in BASIC_VIOL.items())}
  from rv where has_inspection group by carrier_operation
) unpivot (rate for BASIC in ({', '.join(f'"{k}"' for k in BASIC_VIOL)}))"""))
def q_basic_rate_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C2d: violations per inspection in each BASIC, by operation (ratio of sums, long)."""
    df = inspected(spark, sf_dir)
    wide = df.groupBy("carrier_operation").agg(
        *[(F.sum(c) / F.sum("total_inspections")).alias(k) for k, c in BASIC_VIOL.items()])
    return A.unpivot_long(wide, ["carrier_operation"], list(BASIC_VIOL), "BASIC", "rate")


@query("topk", with_master("""
select phy_state, count(*) as n from rv group by phy_state order by n desc, phy_state limit 15"""))
def q_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 15 states with most carriers (no ties kept; alphabetical tie-break)."""
    counts = A.freq_count(rv(spark, sf_dir), "phy_state")
    return A.top_k(counts, [F.desc("n"), F.asc("phy_state")], 15)


@query("min_group_size", with_master(f"""
select phy_state, n, {r6('avg_oos')} as avg_oos from (
  select phy_state, count(*) as n, avg(oos_rate) as avg_oos from rv where has_inspection group by phy_state
  having count(*) >= 500) qualify rank() over (order by n desc) <= 20"""))
def q_min_group_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State OOS rate among states with >= 500 inspected carriers, top 20 by size (ties kept)."""
    g = inspected(spark, sf_dir).groupBy("phy_state").agg(F.count(F.lit(1)).alias("n"),
                                                          F.avg("oos_rate").alias("avg_oos"))
    return A.top_k_ties(A.min_group_size(g, "n", 500), [F.desc("n")], 20)


@query("group_sums", with_master(f"""
select phy_state, {r6('coalesce(sum(sum_severity_weight), 0)')} as total_sev, count(*) as n
from rv group by phy_state"""))
def q_group_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity weight summed per state."""
    return A.group_sums(rv(spark, sf_dir), ["phy_state"], {"total_sev": "sum_severity_weight"})


@query("topk_ties", with_master(f"""
select phy_state, {r6('total_sev')} as total_sev, n from (
  select phy_state, coalesce(sum(sum_severity_weight), 0) as total_sev, count(*) as n from rv group by phy_state)
qualify rank() over (order by total_sev desc) <= 15"""))
def q_topk_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """15 states with the largest severity total, ties at 15 kept."""
    sums = A.group_sums(rv(spark, sf_dir), ["phy_state"], {"total_sev": "sum_severity_weight"})
    return A.top_k_ties(sums, [F.desc("total_sev")], 15)


_C4A = {
    "Avg power units": ("nbr_power_unit", False),
    "Avg drivers": ("driver_total", False),
    "Avg OOS rate": ("oos_rate", False),
    "Avg crashes": ("total_crashes", False),
    "Avg intensity score": ("violation_intensity_score", False),
}


@query("ntile_decile", with_master(f"""
select tier, metric, {r6('value')} as value from (
  select tier, avg(nbr_power_unit) as "Avg power units", avg(driver_total) as "Avg drivers",
    avg(oos_rate) as "Avg OOS rate", avg(total_crashes) as "Avg crashes",
    avg(violation_intensity_score) as "Avg intensity score",
    avg(cast(hm_flag_lgl as double)) * 100 as "% Hazmat",
    case when count(*) = count(carrier_operation) then avg(cast(carrier_operation = 'A' as double)) * 100 end
      as "% Interstate"
  from (select *, case when ntile(10) over (order by sum_severity_weight, dot_number) = 10
                       then 'Top 10% severity' else 'Bottom 90%' end as tier
        from rv where has_inspection)
  group by tier
) unpivot include nulls (value for metric in ("Avg power units", "Avg drivers", "Avg OOS rate", "Avg crashes",
                                              "Avg intensity score", "% Hazmat", "% Interstate"))"""))
def q_ntile_decile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profile of the top severity decile vs the rest (exact distributed ntile)."""
    df = inspected(spark, sf_dir)
    dec = rank.ntile(df, 10, [F.col("sum_severity_weight").asc(), F.col("dot_number").asc()], out="risk_decile")
    dec = dec.withColumn("tier", F.when(F.col("risk_decile") == 10, F.lit("Top 10% severity"))
                         .otherwise(F.lit("Bottom 90%")))
    aggs = [F.avg(col).alias(name) for name, (col, _) in _C4A.items()]
    aggs.append((F.avg(F.col("hm_flag_lgl").cast("double")) * 100).alias("% Hazmat"))
    # mean without na.rm: NULL when any operation code is missing
    aggs.append(F.when(F.count(F.lit(1)) == F.count("carrier_operation"),
                       F.avg((F.col("carrier_operation") == "A").cast("double")) * 100).alias("% Interstate"))
    wide = dec.groupBy("tier").agg(*aggs)
    return A.unpivot_long(wide, ["tier"], list(_C4A) + ["% Hazmat", "% Interstate"], "metric", "value")


# ------------------------------------------------------------------ data quality
@query("missing_profile", with_master(f"""
select "column", {r6('missing_pct')} as missing_pct from (
  unpivot (select avg(case when columns(*) is null then 100.0 else 0.0 end) from rv)
  on columns(*) into name "column" value missing_pct)
where missing_pct > 0 order by missing_pct desc, "column" limit 25"""))
def q_missing_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: top 25 columns by missing share."""
    return clean.missing_profile(rv(spark, sf_dir), 25)


def _summary_sql(cols) -> str:
    parts = [f"""select '{c}' as "column", {r6(f'min({c})')} as min, {r6(f'quantile_cont({c}, 0.25)')} as q1,
  {r6(f'quantile_cont({c}, 0.5)')} as median, {r6(f'avg({c})')} as mean, {r6(f'quantile_cont({c}, 0.75)')} as q3,
  {r6(f'max({c})')} as max, count(*) - count({c}) as n_missing from rv""" for c in cols]
    return with_master("\nunion all\n".join(parts))


@query("numeric_summary", _summary_sql(SUMMARY_COLUMNS))
def q_numeric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: six-number summary + NULL count per numeric column, one pass."""
    return A.numeric_summary(rv(spark, sf_dir), list(SUMMARY_COLUMNS))


@query("exact_quantiles", with_master("\nunion all\n".join(
    f"select carrier_operation, {r6(_dbl(p))} as prob, {r6(f'quantile_cont(oos_rate, {_dbl(p)})')} as value "
    f"from rv where has_inspection group by carrier_operation" for p in QUANTILE_PROBS)))
def q_exact_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact interpolated quantiles of the OOS rate by operation."""
    return A.exact_quantiles(inspected(spark, sf_dir), "oos_rate", QUANTILE_PROBS, ["carrier_operation"])


@query("sorted_report", with_master(f"""
select phy_state, {r6('avg(fatal_crash_rate)')} as avg_fatal_rate, count(*) as n
from rv where total_crashes > 0 group by phy_state order by avg_fatal_rate desc nulls last"""))
def q_sorted_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-state mean fatal-crash rate, sorted descending with NULLs last."""
    g = rv(spark, sf_dir).where(F.col("total_crashes") > 0).groupBy("phy_state").agg(
        F.avg("fatal_crash_rate").alias("avg_fatal_rate"), F.count(F.lit(1)).alias("n"))
    return g.orderBy(F.desc_nulls_last("avg_fatal_rate"))


@query("argmax_row", with_master(f"""
select carrier_operation, dot_number, {r6('sum_severity_weight')} as sum_severity_weight from (
  select carrier_operation, dot_number, sum_severity_weight,
    row_number() over (partition by carrier_operation order by sum_severity_weight desc, dot_number) as k from rv)
where k = 1"""))
def q_argmax_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The carrier with the largest severity weight per operation (smallest key on ties)."""
    df = rv(spark, sf_dir).select("carrier_operation", "dot_number", "sum_severity_weight")
    return A.argmax_row(df, "sum_severity_weight", ["carrier_operation"], [F.col("dot_number")])


@query("required_columns", with_master(" union all ".join(
    f"select '{c}' as \"column\", true as present, count({c}) as n_values from rv" for c in NEEDED_COLUMNS)))
def q_required_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the report view carries every column the reports need, and how many rows fill it."""
    return clean.required_columns(rv(spark, sf_dir), NEEDED_COLUMNS)


@query("null_counts", with_master(" union all ".join(
    f"select '{c}' as \"column\", count(*) - count({c}) as n_missing from rv" for c in SUMMARY_COLUMNS)))
def q_null_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NULL count of each numeric report column."""
    return clean.null_counts(rv(spark, sf_dir).select(*SUMMARY_COLUMNS))


@query("ordered_levels", with_master("""
select dot_number, oos_flag, case oos_flag when 'Clean' then 0 when 'OOS' then 1 end as oos_level from rv"""))
def q_ordered_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed level order of the target (Clean = 0, OOS = 1)."""
    return rv(spark, sf_dir).select("dot_number", "oos_flag",
                                    S.level_index("oos_flag", ("Clean", "OOS")).alias("oos_level"))


@query("mid_rank", with_master(f"""
select dot_number, {r6('oos_rate')} as oos_rate, {r6('avg(rn) over (partition by oos_rate)')} as mid_rank from (
  select dot_number, oos_rate, row_number() over (order by oos_rate) as rn from rv where has_inspection)"""))
def q_mid_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average rank of the OOS rate among inspected carriers (ties share the mean rank)."""
    df = inspected(spark, sf_dir).select("dot_number", "oos_rate")
    return rank.mid_rank(df, "oos_rate")
