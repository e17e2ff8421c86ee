"""Raw CSV input, column-name normalisation, shape report and checkpoints."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"
NA = "NA"  # missing value in the raw files


def snake_case(name: str) -> str:
    """Lower-case, non-alphanumerics to ``_``, camelCase split, trimmed."""
    s = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name.strip())
    s = re.sub(r"[^0-9A-Za-z]+", "_", s).strip("_").lower()
    if not s:
        s = "x"
    if s[0].isdigit():
        s = "x" + s
    return s


def clean_names(df: DataFrame) -> DataFrame:
    """snake_case column names; collisions get ``_2``, ``_3`` ..."""
    seen: dict[str, int] = {}
    out = []
    for name in df.columns:
        base = snake_case(name)
        n = seen.get(base, 0) + 1
        seen[base] = n
        out.append(base if n == 1 else f"{base}_{n}")
    return df.toDF(*out)


def string_schema(columns: Sequence[str], corrupt: bool = True) -> T.StructType:
    fields = [T.StructField(c, T.StringType(), True) for c in columns]
    if corrupt:
        fields.append(T.StructField(CORRUPT, T.StringType(), True))
    return T.StructType(fields)


def read_raw(spark: SparkSession, path: str, columns: Sequence[str] | None = None, on_corrupt: str = "flag",
             multi_line: bool = False) -> DataFrame:
    """Read a headed CSV with every column as text (types come from the cleaning step).

    ``NA`` and empty fields are NULL, and a doubled quote stands for one in a
    quoted field.  ``multi_line`` also reads quoted line ends, but then a
    file is one task.  With an explicit column list no inference pass runs,
    and malformed lines are treated by ``on_corrupt``: ``flag`` keeps them,
    with the line in ``_corrupt_record``; ``keep`` keeps the fields that were
    read; ``drop`` leaves them out; ``fail`` stops the job that meets one.
    """
    if on_corrupt not in ("flag", "keep", "drop", "fail"):
        raise ValueError(f"on_corrupt={on_corrupt!r}")
    reader = (spark.read.option("header", True).option("mode", "PERMISSIVE").option("nullValue", NA)
              .option("quote", '"').option("escape", '"').option("multiLine", multi_line))
    if columns is None:
        return empty_to_null(clean_names(reader.option("inferSchema", False).csv(path)))
    # positional schema with the caller's (already clean) names; header line skipped
    df = (reader.schema(string_schema([snake_case(c) for c in columns])).option("columnNameOfCorruptRecord", CORRUPT).csv(path))
    bad = F.col(CORRUPT).isNotNull()
    if on_corrupt == "drop":
        df = df.where(~bad)
    elif on_corrupt == "fail":
        df = df.withColumn(CORRUPT, F.when(bad, F.raise_error(F.concat(F.lit("malformed line: "), CORRUPT))))
        df = df.where(F.col(CORRUPT).isNull())
    df = empty_to_null(df)
    return df if on_corrupt == "flag" else df.drop(CORRUPT)


def empty_to_null(df: DataFrame) -> DataFrame:
    return df.select(*[F.nullif(F.col(c), F.lit("")).alias(c) for c in df.columns])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def shape_report(tables: dict[str, DataFrame]) -> DataFrame:
    """S3: rows x columns per table, as one small frame (one count job per table)."""
    parts = [df.agg(F.count(F.lit(1)).alias("n_rows"))
               .select(F.lit(name).alias("table"), "n_rows", F.lit(len(df.columns)).alias("n_cols"))
             for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_checkpoint(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write a table (Parquet by default; CSV with a header as option)."""
    if fmt == "csv":
        write_csv(df, path)
    else:
        df.write.mode("overwrite").parquet(path)


def read_checkpoint(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Read a written checkpoint back; Parquet keeps the types."""
    if fmt == "csv":
        return spark.read.option("header", True).option("inferSchema", True).csv(path)
    return spark.read.parquet(path)
