"""Scalar column expressions shared by the operators (section 2.9 functions).

Everything here is a plain ``pyspark.sql.functions`` composition, so it stays
inside whole-stage codegen and pushes through Catalyst like any built-in.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def key_hash(*keys: Column | str, salt: str | None = None) -> Column:
    """Stable 32-bit bucket of a row key: first 8 hex digits of md5, as a long.

    The same number is ``('0x' || substr(md5(k), 1, 8))::bigint`` in DuckDB, so
    splits and folds are reproducible across engines and re-runs, and do not
    depend on partitioning or row order (unlike ``rand``).
    """
    parts = [col(k).cast("string") for k in keys]
    if salt is not None:
        parts.append(F.lit(salt))
    text = parts[0] if len(parts) == 1 else F.concat_ws("-", *parts)
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def key_hash_sql(*keys: str, salt: str | None = None) -> str:
    parts = [f"CAST({k} AS VARCHAR)" for k in keys]
    if salt is not None:
        parts.append(f"'{salt}'")
    text = parts[0] if len(parts) == 1 else "concat_ws('-', " + ", ".join(parts) + ")"
    return f"CAST(('0x' || substr(md5({text}), 1, 8)) AS BIGINT)"


def category_string(c: Column | str) -> Column:
    """Category as text, null becomes the literal ``'nan'``."""
    return F.coalesce(col(c).cast("string"), F.lit("nan"))


def indicator(c: Column | str, value) -> Column:
    """1.0 where ``c == value`` else 0.0 (null compares false)."""
    return F.when(col(c) == F.lit(value), F.lit(1.0)).otherwise(F.lit(0.0))


def bin_index(x: Column | str, lo: Column, hi: Column, bins: int) -> Column:
    """0-based equal-width bin of ``x`` over ``[lo, hi]``; the last bin is closed.

    ``lo``/``hi`` are already widened by 0.5 when they are equal.
    """
    width = (hi - lo) / F.lit(float(bins))
    return F.least(F.floor((col(x) - lo) / width).cast("int"), F.lit(bins - 1))


def widened_bounds(lo: Column, hi: Column) -> tuple[Column, Column]:
    """Constant column: widen the range by 0.5 on each side (histogram rule)."""
    same = lo == hi
    return (F.when(same, lo - 0.5).otherwise(lo), F.when(same, hi + 0.5).otherwise(hi))


def normal_pdf(z: Column) -> Column:
    return F.exp(-0.5 * z * z) / F.lit(math.sqrt(2.0 * math.pi))


def normal_cdf(z: Column) -> Column:
    """Standard normal CDF via the Abramowitz-Stegun 7.1.26 erf approximation."""
    # Coefficients of Abramowitz & Stegun formula 7.1.26.
    p, a1, a2, a3, a4, a5 = 0.3275911, 0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429
    x = F.abs(z) / F.lit(math.sqrt(2.0))
    t = 1.0 / (1.0 + p * x)
    poly = ((((a5 * t + a4) * t + a3) * t + a2) * t + a1) * t
    erf = 1.0 - poly * F.exp(-x * x)
    return F.when(z >= 0, 0.5 * (1.0 + erf)).otherwise(0.5 * (1.0 - erf))


def is_numeric_type(dt: T.DataType) -> bool:
    """Numeric semantic type: ints, floats, decimals; booleans are not numeric."""
    return isinstance(dt, T.NumericType)


def round_floats(df, digits: int = 6):
    """Round every float/double column (for stable cross-engine comparison)."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(F.round(F.col(f.name), digits).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)
