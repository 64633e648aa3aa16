"""Number functions as Columns: clipping, ratios, idf, DCG, formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """FN-18."""
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 (FN-18)."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def positive(c: Column) -> Column:
    return F.greatest(F.coalesce(c.cast("double"), F.lit(0.0)), F.lit(0.0))


def bm25_idf(df: Column, n: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def capped_idf(df: Column, n: Column, most: float = 0.45) -> Column:
    """ln((n+1)/(df+1)) + 1, 0 above a share of n (FN-19)."""
    return F.when((n <= 0) | (df / n > most), F.lit(0.0)).otherwise(F.log((n + 1) / (df + 1)) + 1)


def smooth_idf(df: Column, n: Column) -> Column:
    """ln(1 + (n+1)/(df+1)) (FN-19)."""
    return F.log1p((n + 1) / (df + 1))


def gain(relevance: Column, position: Column) -> Column:
    """One term of DCG; positions from 1 (FN-17)."""
    return (F.pow(F.lit(2.0), relevance) - 1) / F.log2(position + 1)


def rrf(rank: Column, k: int = 60) -> Column:
    return 1.0 / (k + rank)


def fixed(c: Column, places: int = 4) -> Column:
    """FN-35."""
    return F.when(c.isNotNull(), F.format_string(f"%.{places}f", c.cast("double"))).otherwise(F.lit(""))
