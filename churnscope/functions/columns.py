"""Column-level helpers shared by the operators (all JVM-side expressions)."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stats import nan_to_null

# A plain decimal or scientific number, or +-inf/infinity, with blanks around it.
# pandas.to_numeric accepts these and rejects e.g. '12d', '1.5f' or '1_000',
# which Spark's cast alone would accept or reject differently.
NUMERIC_PATTERN = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|inf|infinity)\s*$"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_numeric(c: Column | str) -> Column:
    """B1: unparsable text -> NULL; 'nan' -> NULL; numbers pass through as double."""
    c = col(c)
    s = F.lower(c.cast("string"))
    parsed = F.when(s.rlike(NUMERIC_PATTERN), F.trim(s).try_cast("double"))
    return nan_to_null(parsed)


def to_date_coerce(c: Column | str) -> Column:
    """B2: unparsable dates -> NULL."""
    c = col(c)
    return F.coalesce(c.try_cast("date"), F.to_date(F.try_to_timestamp(c.cast("string"))))


def coerce_numeric(df: DataFrame, cols: Iterable[str], fill: float | None = None) -> DataFrame:
    """B1 + B3 (+ B17 when a column is absent: it is added as ``fill``)."""
    out = {}
    for c in cols:
        if c in df.columns:
            v = to_numeric(c) if dict(df.dtypes)[c] == "string" else nan_to_null(F.col(c).cast("double"))
        else:
            v = F.lit(None).cast("double")
        out[c] = F.coalesce(v, F.lit(float(fill))) if fill is not None else v
    return df.withColumns(out)


def clip_lower(c: Column | str, lo: float) -> Column:
    """Lower clip keeping NULL (``greatest`` alone would skip NULL)."""
    c = col(c)
    return F.when(c.isNull(), None).otherwise(F.greatest(c, F.lit(lo)))


def clip_upper(c: Column | str, hi) -> Column:
    c = col(c)
    hi = hi if isinstance(hi, Column) else F.lit(hi)
    return F.when(c.isNull(), None).otherwise(F.least(c, hi))


def text_normalise(c: Column | str, remove: str | None = None) -> Column:
    """Strip + lower; optionally remove a fixed phrase and strip again."""
    c = F.lower(F.trim(col(c)))
    if remove:
        c = F.trim(F.replace(c, F.lit(remove), F.lit("")))
    return c


def safe_div(num: Column, den: Column) -> Column:
    """Division yielding NULL on a zero denominator (pandas would give inf/NaN)."""
    return F.try_divide(num, den)


def log1p_safe(c: Column | str) -> Column:
    """log(1+x); NULL for x <= -1 (pandas gives -inf / NaN there)."""
    c = col(c)
    return F.when(c > -1, F.log1p(c))


def dummy_name(prefix: str, level: str) -> str:
    """Column name of a one-hot level: prefix_level with non-word characters as '_'."""
    return f"{prefix}_{re.sub(r'[^0-9A-Za-z_]', '_', str(level))}"


def dummy_names(prefix: str, levels: Iterable[str]) -> dict[str, str]:
    """Level -> column name; levels whose names would coincide get _2, _3, ... in their sorted order."""
    out: dict[str, str] = {}
    for level in levels:
        name, n = dummy_name(prefix, level), 2
        while name.lower() in {x.lower() for x in out.values()}:
            name, n = f"{dummy_name(prefix, level)}_{n}", n + 1
        out[level] = name
    return out


def state_from_thresholds(c: Column | str, lo, hi, labels: tuple[str, str, str]) -> Column:
    """<= lo -> label0, <= hi -> label1, else label2 (NULL also gets label2)."""
    c = col(c)
    lo = lo if isinstance(lo, Column) else F.lit(lo)
    hi = hi if isinstance(hi, Column) else F.lit(hi)
    return F.when(c <= lo, labels[0]).when(c <= hi, labels[1]).otherwise(labels[2])
