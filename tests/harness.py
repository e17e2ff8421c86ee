"""Spark-vs-DuckDB comparison used by the oracle tests and by hand.

    python -m tests.harness [sf_dir] [name ...]

For each registered query with oracle SQL: row count, column names, a
coarse type match and an order-insensitive multiset of rows must agree.
"""

from __future__ import annotations

import sys
import time
from collections import Counter

import pyarrow as pa

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _kind(t: pa.DataType) -> str:
    if pa.types.is_string(t) or pa.types.is_large_string(t):
        return "string"
    if pa.types.is_integer(t):
        return f"int{t.bit_width}"
    if pa.types.is_floating(t):
        return "float"
    if pa.types.is_boolean(t):
        return "bool"
    if pa.types.is_decimal(t):
        return "decimal"
    return str(t)


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if v != v:
            return "nan"
        return round(v, 6) + 0.0
    if isinstance(v, list):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def rows_of(tbl: pa.Table) -> Counter:
    cols = sorted(tbl.column_names)
    data = [tbl.column(c).to_pylist() for c in cols]
    return Counter(tuple(_norm(col[i]) for col in data) for i in range(tbl.num_rows))


def compare(spark_tbl: pa.Table, duck_tbl: pa.Table) -> list[str]:
    problems = []
    if sorted(spark_tbl.column_names) != sorted(duck_tbl.column_names):
        problems.append(f"columns {sorted(spark_tbl.column_names)} != {sorted(duck_tbl.column_names)}")
        return problems
    for c in spark_tbl.column_names:
        ks, kd = _kind(spark_tbl.schema.field(c).type), _kind(duck_tbl.schema.field(c).type)
        if ks != kd:
            problems.append(f"type {c}: spark {ks} duckdb {kd}")
    if spark_tbl.num_rows != duck_tbl.num_rows:
        problems.append(f"rows spark {spark_tbl.num_rows} duckdb {duck_tbl.num_rows}")
    rs, rd = rows_of(spark_tbl), rows_of(duck_tbl)
    if rs != rd:
        only_s = list((rs - rd).elements())[:3]
        only_d = list((rd - rs).elements())[:3]
        problems.append(f"values differ; cols={sorted(spark_tbl.column_names)} spark-only={only_s} duck-only={only_d}")
    return problems


def run(sf_dir: str, names: list[str] | None = None, spark=None) -> dict[str, list[str]]:
    from carrisk.plans.registry import ORACLE, QUERIES, load_all
    from carrisk.session import local_session
    load_all()
    spark = spark or local_session()
    con = duck(sf_dir)
    out = {}
    for name in names or list(QUERIES):
        if name not in ORACLE:
            continue
        t0 = time.time()
        try:
            s_tbl = QUERIES[name](spark, sf_dir).toArrow()
            d_tbl = con.sql(ORACLE[name]).arrow()
            if hasattr(d_tbl, "read_all"):
                d_tbl = d_tbl.read_all()
            out[name] = compare(s_tbl, d_tbl)
        except Exception as e:  # report, keep going
            out[name] = [f"error: {type(e).__name__}: {str(e)[:400]}"]
        status = "OK " if not out[name] else "BAD"
        print(f"{status} {name} ({time.time() - t0:.1f}s) {'; '.join(out[name])[:600]}", flush=True)
    return out


if __name__ == "__main__":
    args = sys.argv[1:]
    sf = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in args if not a.startswith("/")] or None
    res = run(sf, names)
    bad = [k for k, v in res.items() if v]
    print(f"{len(res) - len(bad)}/{len(res)} match; bad: {bad}")
