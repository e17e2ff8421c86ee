"""The Spark binding and its SQL give the same raw rows; every oracle has rows to compare."""

import pytest

from carrisk.plans.registry import ORACLE, load_all
from carrisk.sources import binding
from tests import harness
from tests.conftest import SF001

load_all()


@pytest.mark.parametrize("name", sorted(binding.BINDING_SQL))
def test_binding_equals_sql(spark, name):
    con = harness.duck(SF001)
    got = getattr(binding, name)(spark, SF001).toArrow()
    want = con.sql(binding.BINDING_SQL[name]).to_arrow_table()
    cols = sorted(want.column_names)
    assert sorted(got.column_names) == cols and want.num_rows > 0
    text = lambda t: sorted(tuple(str(v) for v in r.values()) for r in t.select(cols).to_pylist())
    assert text(got) == text(want)


def test_no_oracle_is_empty():
    con = harness.duck(SF001)
    assert [n for n, sql in ORACLE.items() if not con.sql(f"select 1 from ({sql}) limit 1").fetchall()] == []
