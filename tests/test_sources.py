"""Raw CSV read with a string schema, name normalisation, checkpoint round trip."""

import os
import tempfile

import pytest

from carrisk.sources import files


def test_clean_names_snake_case_and_collisions(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], ["DOT Number", "NbrPowerUnit", "dot_number", "1st"])
    assert files.clean_names(df).columns == ["dot_number", "nbr_power_unit", "dot_number_2", "x1st"]


def test_read_raw_keeps_text_and_flags_corrupt_lines(spark):
    d = tempfile.mkdtemp(prefix="carrisk-csv-")
    path = os.path.join(d, "census.csv")
    with open(path, "w") as fh:
        fh.write("DOT Number,Nbr Power Unit\n")
        fh.write(" 100000 ,12\n")
        fh.write("7,abc\n")
        fh.write("8,1,extra\n")
    df = files.read_raw(spark, path, ["dot_number", "nbr_power_unit"])
    rows = {r.dot_number: r for r in df.collect()}
    assert rows[" 100000 "].nbr_power_unit == "12"            # keys stay text (no 1e+05)
    assert rows["7"].nbr_power_unit == "abc"
    assert rows["8"][files.CORRUPT] is not None               # malformed line kept and flagged


def test_checkpoint_roundtrip_keeps_types(spark):
    df = spark.createDataFrame([("1", 2.5, 3)], "k string, x double, n int")
    path = tempfile.mkdtemp(prefix="carrisk-ckpt-out-")
    files.write_checkpoint(df, path)
    back = files.read_checkpoint(spark, path)
    assert back.schema == df.schema and back.collect() == df.collect()


def _write(text):
    path = os.path.join(tempfile.mkdtemp(prefix="carrisk-csv-"), "t.csv")
    with open(path, "w") as fh:
        fh.write(text)
    return path


def test_missing_values_and_quotes(spark):
    path = _write('k,v\n1,NA\n2,\n3,""\n4,"said ""no"", then left"\n5,N/A\n')
    rows = {r.k: r.v for r in files.read_raw(spark, path, ["k", "v"], on_corrupt="keep").collect()}
    assert rows == {"1": None, "2": None, "3": None, "4": 'said "no", then left', "5": "N/A"}
    assert {r.k: r.v for r in files.read_raw(spark, path).collect()} == rows


def test_corrupt_policies(spark):
    path = _write("k,v\n1,a\n2,b,extra\n")
    assert files.read_raw(spark, path, ["k", "v"], "flag").columns == ["k", "v", files.CORRUPT]
    assert [tuple(r) for r in files.read_raw(spark, path, ["k", "v"], "keep").collect()] == [("1", "a"), ("2", "b")]
    assert [tuple(r) for r in files.read_raw(spark, path, ["k", "v"], "drop").collect()] == [("1", "a")]
    with pytest.raises(Exception, match="malformed line"):
        files.read_raw(spark, path, ["k", "v"], "fail").collect()
    quoted = _write('k,v\n1,"two\nlines"\n')
    assert files.read_raw(spark, quoted, ["k", "v"], "keep", multi_line=True).first().v == "two\nlines"


def test_merge_check_stops_fan_out(spark):
    from carrisk.plans import master as M
    census = spark.createDataFrame([("1", "S"), ("2", "S"), ("3", None)], "dot_number string, phy_state string")
    tables = M.CleanTables(census, None, None, None)
    M.verify_merge(tables, census.where("phy_state is not null"))  # rows without geography are dropped by the policy
    with pytest.raises(AssertionError, match="fan-out"):
        M.verify_merge(tables, census.where("phy_state is not null").crossJoin(spark.range(2).toDF("x")))


def test_checkpoint_folder_needs_a_shared_place(monkeypatch):
    from carrisk import session

    class Conf:
        def get(self, key, default):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    fake = type("Session", (), {"sparkContext": Context(), "conf": Conf()})()
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(fake)
