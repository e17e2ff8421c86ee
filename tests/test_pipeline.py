"""Rollups, merge, imputation, sampling and the tier encoder on hand-made and fixture frames."""

import math

import pytest
from pyspark.sql import functions as F

from carrisk.operators import clean, model, rollup, sampling
from carrisk.operators.impute import MissingPolicy
from carrisk.plans import master as M
from tests.conftest import SF001


def test_all_null_group_sums_to_zero_and_max_date_null(spark):
    insp = spark.createDataFrame(
        [("1", "u1", None, None), ("1", "u2", None, None), ("2", "u3", 2.0, "2026-01-02")],
        "dot_number string, unique_id string, oos_total double, insp_date string")
    insp = insp.withColumn("insp_date", F.to_date("insp_date"))
    for c in set(rollup.INSPECTION_SUMS.values()) - {"oos_total"}:
        insp = insp.withColumn(c, F.lit(None).cast("double"))
    got = {r.dot_number: r for r in rollup.insp_agg(insp).collect()}
    assert got["1"].sum_oos_total == 0 and got["1"].last_inspection is None
    assert got["2"].sum_oos_total == 2.0 and got["1"].total_inspections == 2


def test_fused_rollup_equals_separate_with_duplicate_parent(spark):
    insp = spark.createDataFrame([("c1", "i1"), ("c1", "i1"), ("c2", "i2"), ("c3", "i3")],
                                 "dot_number string, unique_id string")
    for c in rollup.INSPECTION_SUMS.values():
        insp = insp.withColumn(c, F.lit(1.0))
    insp = insp.withColumn("insp_date", F.current_date())
    viol = spark.createDataFrame([("i1", 1), ("i1", 0), ("i2", 1), ("zz", 1)],
                                 "inspection_id string, out_of_service_flag int")
    fused = {r.dot_number: (r.total_violations_recorded, r.total_oos_violations)
             for r in rollup.carrier_rollup(insp, viol).collect()}
    sep = {r.dot_number: (r.total_violations_recorded, r.total_oos_violations)
           for r in rollup.viol_agg(viol, insp).collect()}
    assert fused["c1"] == sep["c1"] == (4, 2)      # the duplicated parent fans out
    assert fused["c2"] == sep["c2"] == (1, 1)
    assert fused["c3"] == (0, 0) and "c3" not in sep
    assert rollup.duplicate_keys(insp, "unique_id").count() == 1


def test_merge_integrity_raises_on_fan_out(spark):
    census = spark.createDataFrame([("1",), ("2",)], "dot_number string")
    bad = census.unionByName(census)
    with pytest.raises(AssertionError):
        rollup.merge_integrity(census, bad)


def test_dedupe_keeps_first(spark):
    df = spark.createDataFrame([("7", "x", 2), ("7", "y", 1), ("8", "z", 5)], "k string, v string, o int")
    got = {r.k: r.v for r in clean.dedupe_keep_first(df, "k", "o").collect()}
    assert got == {"7": "y", "8": "z"}


def test_missing_policy_groups(spark):
    df = spark.createDataFrame(
        [("1", None, 2.0, None, "S1"), ("2", 4.0, 0.0, "d", "S2"), ("3", 6.0, None, None, None)],
        "dot_number string, nbr_power_unit double, driver_total double, dba_name string, phy_state string")
    pol = MissingPolicy().fit(df)
    out = {r.dot_number: r for r in pol.transform(df).collect()}
    assert set(out) == {"1", "2"}                                   # geography drop
    assert out["1"].nbr_power_unit == 5.0 and out["1"].dba_name == "UNKNOWN"
    assert out["2"].driver_total == 0.0                             # explicit zero stays (F21)


@pytest.fixture(scope="module")
def mframe(spark):
    return model.model_frame(M.master_for(spark, SF001)).persist()


@pytest.mark.parametrize("parts", [1, 4, 32])
def test_split_exact_and_partition_independent(spark, mframe, parts):
    sp = sampling.strat_split(mframe.repartition(parts), "oos_flag", "dot_number", 0.7, 42)
    counts = {(r.oos_flag, r.split): r["count"] for r in sp.groupBy("oos_flag", "split").count().collect()}
    for cls in ("OOS", "Clean"):
        n = counts.get((cls, "train"), 0) + counts.get((cls, "test"), 0)
        assert counts[(cls, "train")] == math.floor(0.7 * n)
    assert sp.count() == mframe.count() and sp.select("dot_number").distinct().count() == mframe.count()
    if parts == 1:
        test_split_exact_and_partition_independent.ref = sorted(sp.select("dot_number", "split").collect())
    else:
        assert sorted(sp.select("dot_number", "split").collect()) == test_split_exact_and_partition_independent.ref


def test_folds_balanced(spark, mframe):
    f = sampling.strat_folds(mframe, "oos_flag", "dot_number", 5)
    rows = f.groupBy("oos_flag", "fold").count().collect()
    for cls in ("OOS", "Clean"):
        sizes = [r["count"] for r in rows if r.oos_flag == cls]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1


def test_tier_encoder_ignores_test_rows(spark, mframe):
    sp = sampling.strat_split(mframe, "oos_flag", "dot_number")
    train = sp.where(F.col("split") == "train")
    enc1 = model.StateTierEncoder().fit(train)
    flipped = sp.withColumn("oos_flag", F.when(F.col("split") == "test", F.lit("OOS")).otherwise(F.col("oos_flag")))
    enc2 = model.StateTierEncoder().fit(flipped.where(F.col("split") == "train"))
    t1, t2 = (sorted(map(tuple, e.table().select("phy_state", "state_risk_tier").collect())) for e in (enc1, enc2))
    assert t1 == t2 and len(t1) > 0
    unseen = spark.createDataFrame([("NOWHERE",)], "phy_state string")
    assert enc1.transform(unseen).first()["state_risk_tier_label"] == "MED"


def test_tier_encoder_degenerate_cuts(spark):
    df = spark.createDataFrame([("S%d" % (i % 3), "OOS") for i in range(120)], "phy_state string, oos_flag string")
    enc = model.StateTierEncoder().fit(df)
    assert enc.degenerate and enc.transform(df).select("state_risk_tier_label").distinct().collect()[0][0] == "MED"


def test_class_weights(spark):
    df = spark.createDataFrame([("OOS",)] * 30 + [("Clean",)] * 70, "oos_flag string")
    w = sampling.class_weights(df, "oos_flag")
    assert abs(w["OOS"] - 100 / 60) < 1e-12 and abs(w["Clean"] - 100 / 140) < 1e-12


def test_winsorizer_fit_on_train_only(spark):
    train = spark.createDataFrame([(float(i),) for i in range(101)], "drivers_per_unit double")
    w = model.Winsorizer().fit(train)
    assert abs(w.cap - 99.0) < 1e-9
    test = spark.createDataFrame([(1e6,)], "drivers_per_unit double")
    assert w.transform(test).first()[0] == w.cap
