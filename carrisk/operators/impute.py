"""The four-group missing-value policy (N5-N8) as one declarative object.

1. structural zeros (event counts after the left joins) -> 0
2. core operating metrics -> exact median (fitted on the frame given to ``fit``)
3. optional text columns -> "UNKNOWN"
4. geography -> drop the row

Only columns present in the frame are touched (data vintages differ).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carrisk.operators import rank
from carrisk.operators.clean import present
from carrisk.operators.rollup import ZERO_FILL, zero_fill

MEDIAN_FILL = ("nbr_power_unit", "driver_total")
UNKNOWN_FILL = ("dba_name", "legal_name", "vmt_source_id", "op_other", "telephone")
GEOGRAPHY = ("phy_state", "phy_city", "phy_zip")


def fit_medians(df: DataFrame, columns=MEDIAN_FILL) -> dict[str, float | None]:
    """Exact medians of all columns in one shared pass (``rank.quantiles``; a row per column to the driver)."""
    cols = present(df, columns)
    if not cols:
        return {}
    found = {r["column"]: r["q"][0] for r in rank.quantiles(df, {c: c for c in cols}, [0.5]).collect()}
    return {c: found.get(c) for c in cols}


def impute_median(df: DataFrame, medians: dict[str, float | None], zero_is_missing: bool = False) -> DataFrame:
    """Fill NULLs (and, optionally, explicit zeros) with fitted medians."""
    exprs = {}
    for c, m in medians.items():
        if m is None:
            continue
        col = F.col(c)
        missing = col.isNull() | (col == 0) if zero_is_missing else col.isNull()
        exprs[c] = F.when(missing, F.lit(float(m))).otherwise(col)
    return df.withColumns(exprs) if exprs else df


def impute_unknown(df: DataFrame, columns=UNKNOWN_FILL, token: str = "UNKNOWN") -> DataFrame:
    """NULL text -> "UNKNOWN" on the columns present."""
    cols = present(df, columns)
    return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(token)) for c in cols}) if cols else df


def drop_missing_geo(df: DataFrame, columns=GEOGRAPHY) -> DataFrame:
    """Drop rows lacking any present geography column."""
    cols = present(df, columns)
    return df.dropna(how="any", subset=cols) if cols else df


@dataclass
class MissingPolicy:
    zero_columns: tuple[str, ...] = ZERO_FILL
    median_columns: tuple[str, ...] = MEDIAN_FILL
    unknown_columns: tuple[str, ...] = UNKNOWN_FILL
    geography_columns: tuple[str, ...] = GEOGRAPHY
    zero_is_missing: bool = False
    medians: dict[str, float | None] = field(default_factory=dict)

    def fit(self, df: DataFrame) -> "MissingPolicy":
        self.medians = fit_medians(df, self.median_columns)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        out = zero_fill(df, self.zero_columns)
        out = impute_median(out, self.medians, self.zero_is_missing)
        out = impute_unknown(out, self.unknown_columns)
        return drop_missing_geo(out, self.geography_columns)
