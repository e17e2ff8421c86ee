"""Bind the driver's TPC-H-style tables to the four raw carrier tables.

carrier = customer (+ nation as state), inspection = order,
violation line = line item, crash = event.  The real inputs are CSV files
(``load_raw``); this binding gives the same raw shape from
the Parquet test tables: numeric columns typed, flags and keys left as raw
text so the cleaning operators have real work to do, and NULLs, odd flag
spellings, never-inspected carriers and rates above 1 planted by rule.

``BINDING_SQL`` is the same binding as portable SQL (used as CTEs by the
DuckDB oracle); ``tests/test_binding.py`` checks the two agree row for row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from carrisk.sources.files import read_raw

TABLES = ("customer", "nation", "orders", "lineitem", "events")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _mod(c: str, m: int) -> Column:
    return F.col(c) % F.lit(m)


def _yn(cond: Column, yes: str, no: str) -> Column:
    return F.when(cond, F.lit(yes)).otherwise(F.lit(no))


def _01(cond: Column) -> Column:
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))


def census_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    cust = read_table(spark, sf_dir, "customer")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    # half of the carriers stand in one large state, the others in eight
    state = F.when(_mod("c_custkey", 10) < 5, F.lit(24)).otherwise(_mod("c_nationkey", 8))
    c = cust.join(nation, state == nation.n_nationkey)
    seg = F.col("c_mktsegment")
    return c.select(
        F.col("c_custkey").cast("string").alias("dot_number"),
        F.when(_mod("c_custkey", 10) == 0, F.lit(None).cast("double"))
         .otherwise(F.floor(F.abs(F.col("c_acctbal")) / 100).cast("double")).alias("nbr_power_unit"),
        F.when(_mod("c_custkey", 13) == 0, F.lit(None).cast("double"))
         .otherwise((_mod("c_custkey", 50) + 1).cast("double")).alias("driver_total"),
        F.when(_mod("c_custkey", 211) == 0, F.lit(None).cast("string"))
         .when(seg.isin("AUTOMOBILE", "BUILDING"), F.lit("A"))
         .when(seg == "FURNITURE", F.lit("B")).otherwise(F.lit("C")).alias("carrier_operation"),
        F.when(_mod("c_custkey", 4) == 0, F.lit(" y ")).when(_mod("c_custkey", 4) == 1, F.lit("N"))
         .when(_mod("c_custkey", 4) == 2, F.lit("N/A")).otherwise(F.lit("no")).alias("hm_flag"),
        _yn(_mod("c_custkey", 7) == 0, "TRUE", "0").alias("pc_flag"),
        F.when(_mod("c_custkey", 3) == 0, F.lit(None).cast("string")).otherwise(F.col("c_name")).alias("dba_name"),
        F.when(_mod("c_custkey", 500) == 499, F.lit(None).cast("string")).otherwise(F.col("n_name")).alias("phy_state"),
    )


def inspection_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders").where(_mod("o_custkey", 9) != 0)
    drv = _01(_mod("o_orderkey", 23) == 0)
    veh = F.when((_mod("o_custkey", 37) == 0) | (_mod("o_orderkey", 31) == 0), F.lit(2)).otherwise(F.lit(0))
    haz = _01(_mod("o_orderkey", 97) == 0)
    unsafe = _01(_mod("o_orderkey", 3) == 0)
    fatigued = _01(F.col("o_orderstatus") == "F")
    fitness = _01(_mod("o_orderkey", 11) == 0)
    alcohol = F.when(_mod("o_orderkey", 53) == 0, F.lit(None).cast("int")).otherwise(_mod("o_orderkey", 2).cast("int"))
    maint = F.when(F.col("o_orderpriority") == "1-URGENT", F.lit(2)).otherwise(F.lit(0))
    hm = _01(_mod("o_orderkey", 41) == 0)
    return o.select(
        F.col("o_orderkey").cast("string").alias("unique_id"),
        F.col("o_custkey").cast("string").alias("dot_number"),
        F.col("o_orderdate").cast("date").alias("insp_date"),
        drv.alias("driver_oos_total"),
        veh.alias("vehicle_oos_total"),
        haz.alias("hazmat_oos_total"),
        (drv + veh + haz).alias("oos_total"),
        (unsafe + fatigued + fitness + alcohol + maint + hm).alias("basic_viol"),
        unsafe.alias("unsafe_viol"),
        fatigued.alias("fatigued_viol"),
        fitness.alias("dr_fitness_viol"),
        alcohol.alias("subt_alcohol_viol"),
        maint.alias("vh_maint_viol"),
        hm.alias("hm_viol"),
        _yn(_mod("o_orderkey", 3) == 0, "Y", "N").alias("unsafe_insp"),
        _yn(F.col("o_orderstatus") == "F", "yes", "no").alias("fatigued_insp"),
        _yn(_mod("o_orderkey", 11) == 0, "T", "F").alias("dr_fitness_insp"),
        F.when(_mod("o_orderkey", 53) == 0, F.lit(None).cast("string"))
         .when(_mod("o_orderkey", 2) == 1, F.lit("1")).otherwise(F.lit("0")).alias("subt_alcohol_insp"),
        _yn(F.col("o_orderstatus") == "P", "Y", "N").alias("vh_maint_insp"),
        _yn(_mod("o_orderkey", 41) == 0, " Y ", "N/A").alias("hm_insp"),
    )


def violation_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    flag = F.col("l_returnflag")
    return li.select(
        F.col("l_orderkey").cast("string").alias("inspection_id"),
        F.when(flag == "R", F.lit("true")).when(flag == "A", F.lit("N")).otherwise(F.lit(""))
         .alias("out_of_service_indicator"),
    )


def crash_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events")
    et, v = F.col("event_type"), F.col("value")
    return ev.select(
        (F.col("user_id") * 10 + _mod("event_id", 7)).cast("string").alias("dot_number"),  # seven of ten carriers have crashes
        F.col("ts").cast("date").alias("report_date"),
        _01((et == "error") & (v > 150)).alias("fatalities"),
        F.floor(v / 50).cast("int").alias("injuries"),
        _yn(et.isin("error", "purchase"), "Y", "N").alias("tow_away"),
        _yn(et == "signup", "Y", "N").alias("hazmat_released"),
        (F.floor(v / 100) + 1).cast("double").alias("severity_weight"),
        _yn(et == "view", "Y", "N").alias("not_preventable"),
    )


@dataclass(frozen=True)
class RawTables:
    census: DataFrame
    inspection: DataFrame
    violation: DataFrame
    crash: DataFrame


def bind(spark: SparkSession, sf_dir: str) -> RawTables:
    return RawTables(census_raw(spark, sf_dir), inspection_raw(spark, sf_dir),
                     violation_raw(spark, sf_dir), crash_raw(spark, sf_dir))


# Columns of the four raw files, in order.
RAW_COLUMNS: dict[str, tuple[str, ...]] = {
    "census": ("dot_number", "nbr_power_unit", "driver_total", "carrier_operation", "hm_flag", "pc_flag", "dba_name", "phy_state"),
    "inspection": ("unique_id", "dot_number", "insp_date", "driver_oos_total", "vehicle_oos_total", "hazmat_oos_total", "oos_total", "basic_viol",
                   "unsafe_viol", "fatigued_viol", "dr_fitness_viol", "subt_alcohol_viol", "vh_maint_viol", "hm_viol", "unsafe_insp",
                   "fatigued_insp", "dr_fitness_insp", "subt_alcohol_insp", "vh_maint_insp", "hm_insp"),
    "violation": ("inspection_id", "out_of_service_indicator"),
    "crash": ("dot_number", "report_date", "fatalities", "injuries", "tow_away", "hazmat_released", "severity_weight", "not_preventable"),
}


def load_raw(spark: SparkSession, paths: Mapping[str, str], columns: Mapping[str, Sequence[str]] | None = None,
             on_corrupt: str = "keep", multi_line: bool = False) -> RawTables:
    """The four raw tables from CSV files or folders: ``paths`` and ``columns`` by census, inspection, violation, crash.

    All columns are text; the cleaning step types them.
    """
    columns = columns or RAW_COLUMNS
    return RawTables(**{name: read_raw(spark, paths[name], columns[name], on_corrupt, multi_line) for name in RAW_COLUMNS})


# The same binding as SQL (DuckDB and Spark both run it); CTE bodies by name.
BINDING_SQL: dict[str, str] = {
    "census_raw": """
select cast(c_custkey as varchar) as dot_number,
  case when c_custkey%10=0 then null else cast(floor(abs(c_acctbal)/100) as double) end as nbr_power_unit,
  case when c_custkey%13=0 then null else cast(c_custkey%50+1 as double) end as driver_total,
  case when c_custkey%211=0 then null when c_mktsegment in ('AUTOMOBILE','BUILDING') then 'A'
       when c_mktsegment='FURNITURE' then 'B' else 'C' end as carrier_operation,
  case c_custkey%4 when 0 then ' y ' when 1 then 'N' when 2 then 'N/A' else 'no' end as hm_flag,
  case when c_custkey%7=0 then 'TRUE' else '0' end as pc_flag,
  case when c_custkey%3=0 then null else c_name end as dba_name,
  case when c_custkey%500=499 then null else n_name end as phy_state
from customer join nation on n_nationkey=case when c_custkey%10<5 then 24 else c_nationkey%8 end""",
    "inspection_raw": """
select unique_id, dot_number, insp_date, driver_oos_total, vehicle_oos_total, hazmat_oos_total,
  driver_oos_total+vehicle_oos_total+hazmat_oos_total as oos_total,
  unsafe_viol+fatigued_viol+dr_fitness_viol+subt_alcohol_viol+vh_maint_viol+hm_viol as basic_viol,
  unsafe_viol, fatigued_viol, dr_fitness_viol, subt_alcohol_viol, vh_maint_viol, hm_viol,
  unsafe_insp, fatigued_insp, dr_fitness_insp, subt_alcohol_insp, vh_maint_insp, hm_insp
from (select cast(o_orderkey as varchar) as unique_id, cast(o_custkey as varchar) as dot_number,
  cast(o_orderdate as date) as insp_date,
  case when o_orderkey%23=0 then 1 else 0 end as driver_oos_total,
  case when o_custkey%37=0 or o_orderkey%31=0 then 2 else 0 end as vehicle_oos_total,
  case when o_orderkey%97=0 then 1 else 0 end as hazmat_oos_total,
  case when o_orderkey%3=0 then 1 else 0 end as unsafe_viol,
  case when o_orderstatus='F' then 1 else 0 end as fatigued_viol,
  case when o_orderkey%11=0 then 1 else 0 end as dr_fitness_viol,
  case when o_orderkey%53=0 then null else cast(o_orderkey%2 as int) end as subt_alcohol_viol,
  case when o_orderpriority='1-URGENT' then 2 else 0 end as vh_maint_viol,
  case when o_orderkey%41=0 then 1 else 0 end as hm_viol,
  case when o_orderkey%3=0 then 'Y' else 'N' end as unsafe_insp,
  case when o_orderstatus='F' then 'yes' else 'no' end as fatigued_insp,
  case when o_orderkey%11=0 then 'T' else 'F' end as dr_fitness_insp,
  case when o_orderkey%53=0 then null when o_orderkey%2=1 then '1' else '0' end as subt_alcohol_insp,
  case when o_orderstatus='P' then 'Y' else 'N' end as vh_maint_insp,
  case when o_orderkey%41=0 then ' Y ' else 'N/A' end as hm_insp
  from orders where o_custkey%9<>0) o""",
    "violation_raw": """
select cast(l_orderkey as varchar) as inspection_id,
  case l_returnflag when 'R' then 'true' when 'A' then 'N' else '' end as out_of_service_indicator
from lineitem""",
    "crash_raw": """
select cast(user_id*10+event_id%7 as varchar) as dot_number, cast(ts as date) as report_date,
  case when event_type='error' and value>150 then 1 else 0 end as fatalities,
  cast(floor(value/50) as int) as injuries,
  case when event_type in ('error','purchase') then 'Y' else 'N' end as tow_away,
  case when event_type='signup' then 'Y' else 'N' end as hazmat_released,
  cast(1+floor(value/100) as double) as severity_weight,
  case when event_type='view' then 'Y' else 'N' end as not_preventable
from events""",
}
