"""Every registered query with oracle SQL agrees with DuckDB at sf0.01; plans stay JVM-side."""

import pytest

from carrisk.plans.registry import ORACLE, QUERIES, load_all
from tests import harness
from tests.conftest import SF001

load_all()


@pytest.fixture(scope="module")
def con():
    return harness.duck(SF001)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, con, name):
    s_tbl = QUERIES[name](spark, SF001).toArrow()
    d_tbl = con.sql(ORACLE[name]).arrow()
    if hasattr(d_tbl, "read_all"):
        d_tbl = d_tbl.read_all()
    assert d_tbl.num_rows > 0 and harness.compare(s_tbl, d_tbl) == []


@pytest.mark.parametrize("name", ["master_merge", "oos_share_by_operation", "kde_by_group", "strat_split",
                                  "auc_midrank", "box_stats", "insp_agg"])
def test_no_python_udf_in_plan(spark, name):
    plan = QUERIES[name](spark, SF001)._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0 and set(df.columns) == {"carrier_operation", "oos_share", "n"}
    assert set(E.oracle_sql()) <= set(E.queries())
