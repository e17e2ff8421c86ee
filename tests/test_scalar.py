"""Edge rows for the column helpers (flags, keys, numbers, dates, ratios, cuts)."""

from pyspark.sql import functions as F

from carrisk.functions import scalar as S

FLAGS = ["Y", " y ", "YES", "1", "T", "true", "N", "no", "0", "", "NA", "N/A", "null", None, "maybe"]


def test_yn_flag_never_null(spark):
    df = spark.createDataFrame([(x,) for x in FLAGS], "f string")
    got = [r[0] for r in df.select(S.yn_flag("f")).collect()]
    assert got == [1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0]


def test_tri_bool_keeps_unknown(spark):
    df = spark.createDataFrame([(x,) for x in FLAGS], "f string")
    got = [r[0] for r in df.select(S.tri_bool("f")).collect()]
    assert got == [True] * 6 + [False] * 3 + [None] * 6


def test_clean_key_strips_tab_cr_lf(spark):
    df = spark.createDataFrame([("\t123\r\n",), (" 9 ",), ("",), (None,)], "k string")
    assert [r[0] for r in df.select(S.clean_key("k")).collect()] == ["123", "9", "", None]


def test_to_num_tolerant(spark):
    df = spark.createDataFrame([(x,) for x in ["12", " 12 ", "1e3", "abc", "", None]], "x string")
    assert [r[0] for r in df.select(S.to_num("x")).collect()] == [12.0, 12.0, 1000.0, None, None, None]


def test_to_date_safe_formats(spark):
    df = spark.createDataFrame([(x,) for x in ["20260315", "2026-03-15", "15-MAR-26", "bad", None]], "d string")
    got = [r[0] for r in df.select(S.to_date_safe("d").cast("string")).collect()]
    assert got == ["2026-03-15", "2026-03-15", None, None, None]


def test_safe_div(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, None), (3.0, 2.0), (None, 2.0)], "x double, y double")
    assert [r[0] for r in df.select(S.safe_div("x", "y")).collect()] == [0.0, 0.0, 1.5, None]


def test_guarded_ratio_null_predicate(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, None), (3.0, 2.0)], "x double, y double")
    assert [r[0] for r in df.select(S.guarded_ratio("x", "y")).collect()] == [0.0, None, 1.5]


def test_cut_right_closed(spark):
    vals = [-0.01, 0.0, 0.1, 0.25, 0.5, 1.01, 1.02, None]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r[0] for r in df.select(S.cut("x", (-0.01, 0, 0.1, 0.25, 0.5, 1.01),
                                           ("0%", "0-10%", "10-25%", "25-50%", ">50%"))).collect()]
    assert got == [None, "0%", "0-10%", "10-25%", "25-50%", ">50%", None, None]
    low = [r[0] for r in df.select(S.cut("x", (-0.01, 0.5, 1.02), ("lo", "hi"), include_lowest=True)).collect()]
    assert low[0] == "lo" and low[6] == "hi"


def test_log1p_floor_null_is_zero(spark):
    df = spark.createDataFrame([(None,), (-5.0,), (0.0,)], "x double")
    assert [r[0] for r in df.select(S.log1p_floor("x")).collect()] == [0.0, 0.0, 0.0]


def test_recode_and_levels(spark):
    df = spark.createDataFrame([("a",), ("z",), (None,)], "c string")
    out = df.select(S.recode("c", {"a": "Alpha"}).alias("r"), S.level_index("c", ("z", "a")).alias("i")).collect()
    assert [(r.r, r.i) for r in out] == [("Alpha", 1), ("z", 0), (None, None)]


def test_weighted_score_null_propagates(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 1.0)], "a double, b double")
    got = [r[0] for r in df.select(S.weighted_score({"a": 1.5, "b": 0.5})).collect()]
    assert got == [2.5, None]
