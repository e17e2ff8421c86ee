"""Column-level cleaning and feature expressions (all JVM-side, codegen'd).

Every helper maps Column(s) to a Column, so callers compose them inside one
``select``/``withColumns`` and Catalyst keeps them in whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (must equal the analysed pipeline's): whitespace stripped by
# the key trim, and the spellings read as yes / no.
WHITESPACE = " \t\r\n"
YES_TOKENS = ("Y", "YES", "1", "T", "TRUE")
NO_TOKENS = ("N", "NO", "FALSE", "F", "0")

ColumnOrName = Column | str


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_key(c: ColumnOrName) -> Column:
    """Key as string with space/tab/CR/LF stripped at both ends."""
    return F.btrim(_c(c).cast("string"), F.lit(WHITESPACE))


def clean_category(c: ColumnOrName) -> Column:
    """Upper-cased, trimmed category code."""
    return F.upper(clean_key(c))


def to_num(c: ColumnOrName) -> Column:
    """Tolerant number; unparsable text becomes NULL (ANSI-safe)."""
    col = _c(c)
    return F.btrim(col.cast("string"), F.lit(WHITESPACE)).try_cast("double")


def yn_flag(c: ColumnOrName) -> Column:
    """yes/no text to 0/1; anything unrecognised (and NULL) is 0, never NULL."""
    token = clean_category(c)
    return F.coalesce(token.isin(*YES_TOKENS), F.lit(False)).cast("int")


def tri_bool(c: ColumnOrName) -> Column:
    """P5: tri-state boolean: yes -> true, no -> false, anything else -> NULL."""
    token = clean_category(c)
    return (F.when(token.isin(*YES_TOKENS), F.lit(True))
            .when(token.isin(*NO_TOKENS), F.lit(False)))


def to_date_safe(c: ColumnOrName, formats: Sequence[str] = ("yyyyMMdd", "yyyy-MM-dd")) -> Column:
    """Tolerant date; tries each format in order, unparsable -> NULL.

    A column that is already a date (or timestamp) is cast directly.
    """
    s = F.btrim(_c(c).cast("string"), F.lit(WHITESPACE))
    return F.coalesce(*[F.try_to_date(s, fmt) for fmt in formats])


def safe_div(x: ColumnOrName, y: ColumnOrName) -> Column:
    """X / y, but 0 when y is NULL or 0; a NULL x still gives NULL."""
    xc, yc = _c(x), _c(y)
    return (F.when(yc.isNull() | (yc == 0), F.lit(0.0))
            .otherwise(xc.cast("double") / yc.cast("double")))


def guarded_ratio(x: ColumnOrName, y: ColumnOrName) -> Column:
    """X / y when y > 0, else 0; a NULL y gives NULL (NULL predicate)."""
    xc, yc = _c(x), _c(y)
    return (F.when(yc.isNull(), F.lit(None).cast("double"))
            .when(yc > 0, xc.cast("double") / yc.cast("double"))
            .otherwise(F.lit(0.0)))


def log1p_floor(c: ColumnOrName) -> Column:
    """log1p(max(x, 0)), NULL treated as 0 (``greatest`` skips NULLs)."""
    return F.log1p(F.greatest(_c(c).cast("double"), F.lit(0.0)))


def log1p_plain(c: ColumnOrName) -> Column:
    """P10: plain log1p (NULL stays NULL)."""
    return F.log1p(_c(c).cast("double"))


def expm1_plain(c: ColumnOrName) -> Column:
    """P10 inverse: exp(x) - 1."""
    return F.expm1(_c(c).cast("double"))


def weighted_score(weights: Mapping[str, float]) -> Column:
    """Sum of w * column; NULL in any term gives NULL (plain addition)."""
    terms = [F.lit(float(w)) * F.col(name).cast("double") for name, w in weights.items()]
    return reduce(add, terms)


def dummy(c: ColumnOrName, level: str) -> Column:
    """1 if c == level, 0 otherwise, NULL when c is NULL."""
    return (_c(c) == F.lit(level)).cast("int")


def binary_label(c: ColumnOrName, positive: str = "OOS", negative: str = "Clean") -> Column:
    """``c > 0`` -> positive label, else negative (NULL -> NULL)."""
    col = _c(c)
    return F.when(col > 0, F.lit(positive)).when(col.isNotNull(), F.lit(negative))


def cut(c: ColumnOrName, breaks: Sequence[float], labels: Sequence[str],
        include_lowest: bool = False) -> Column:
    """Right-closed interval cut ``(b[i], b[i+1]]`` -> labels[i].

    Values outside ``(b0, bk]`` (and NULL) give NULL.  With
    ``include_lowest`` the first interval is ``[b0, b1]``.
    """
    if len(labels) != len(breaks) - 1:
        raise ValueError("need len(breaks) - 1 labels")
    col = _c(c).cast("double")
    expr = None
    for i, label in enumerate(labels):
        lo, hi = float(breaks[i]), float(breaks[i + 1])
        if i == 0 and include_lowest:
            cond = (col >= F.lit(lo)) & (col <= F.lit(hi))
        else:
            cond = (col > F.lit(lo)) & (col <= F.lit(hi))
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr


def recode(c: ColumnOrName, mapping: Mapping[str, str]) -> Column:
    """Map values through a fixed dictionary; unknown values keep their value."""
    pairs = []
    for k, v in mapping.items():
        pairs += [F.lit(k), F.lit(v)]
    lookup = F.create_map(*pairs)
    col = _c(c)
    return F.coalesce(F.try_element_at(lookup, col), col)


def level_index(c: ColumnOrName, levels: Sequence[str]) -> Column:
    """0-based position of c in an ordered level list; NULL when absent."""
    pos = F.array_position(F.array(*[F.lit(x) for x in levels]), _c(c))
    return F.when(pos > 0, (pos - 1).cast("int"))


def pct_text(c: ColumnOrName, digits: int = 1) -> Column:
    """Share in [0, 1] formatted as a percent string."""
    return F.format_string(f"%.{digits}f%%", _c(c).cast("double") * 100.0)


def fixed_text(c: ColumnOrName, digits: int = 4) -> Column:
    """Fixed-point text such as ``%.4f``."""
    return F.format_string(f"%.{digits}f", _c(c).cast("double"))


def comma_text(c: ColumnOrName) -> Column:
    """Integer with thousands separators."""
    return F.format_number(_c(c).cast("double"), 0)
