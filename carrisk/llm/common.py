"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carrisk.llm.shared_files import filesystem
from carrisk.session import checkpoint, ensure_checkpoint_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` as a query, with DuckDB SQL where there is one."""
    def deco(fn):
        QUERIES[name] = lambda spark, sf_dir: (ship(spark), fn(spark, sf_dir))[1]
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give Python workers this package by ``addPyFile``, once per application, wherever they start."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="carrisk-ship-"), "carrisk-package.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(package):
            for name in (n for n in names if n.endswith(".py")):
                path = os.path.join(folder, name)
                out.write(path, os.path.join("carrisk", os.path.relpath(path, package)))
    sc.addPyFile(archive)
    _SHIPPED.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_path(spark: SparkSession, kind: str) -> str:
    """A new path in the shared checkpoint folder (never a machine-local one on a cluster)."""
    return f"{ensure_checkpoint_dir(spark)}/llm/{kind}-{uuid.uuid4().hex}"


_STEP_TABLES: ContextVar[list[str] | None] = ContextVar("step_tables", default=None)


def written(df: DataFrame, kind: str) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = fresh_path(spark, kind)
    if (tables := _STEP_TABLES.get()) is not None:
        tables.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def step(make: Callable[[], DataFrame], kind: str) -> DataFrame:
    """The rows of ``make()``, written; the tables that ``make`` has written on its way are removed then.

    Nothing that reads these may leave ``make`` but its result.  Steps nest.  Tables stay where ``make`` fails,
    or in a store that only Spark can open.
    """
    token = _STEP_TABLES.set(tables := [])
    try:
        df = make()
    finally:
        _STEP_TABLES.reset(token)
    out = written(df, kind)
    for path in tables:
        try:
            files, inner = filesystem(path)
            files.delete_dir(inner)
        except (OSError, pa.ArrowException):
            pass
    return out


def not_replaced(keep: Iterable[str], new: Iterable[str]) -> list[str]:
    """The kept input columns, without those that a new column of the same name replaces."""
    taken = {n.lower() for n in new}
    return [k for k in keep if k.lower() not in taken]


def text_slices(batches: Iterator[pa.RecordBatch], text_col: str, max_chars: int = 1 << 20,
                ) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a slice holds about ``max_chars`` bytes of text (one row at least).

    A single longer text still comes whole, alone in its slice.
    """
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes.astype(np.int64))
        first = 0
        while first < batch.num_rows:
            base = ends[first - 1] if first else 0
            last = int(np.searchsorted(ends, base + max_chars, side="right"))
            last = max(last, first + 1)
            yield batch.slice(first, last - first)
            first = last
    pa.default_memory_pool().release_unused()  # the worker goes on with other stages


__all__ = ["F", "ORACLE", "QUERIES", "checkpoint", "fresh_path", "not_replaced", "query", "ship", "step", "table", "text_slices", "written"]
