"""Four-valued logic as two-bit masks: 0 neither, 1 true, 2 false, 3 both.  Join is OR, meet is AND."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NEITHER, TRUE, FALSE, BOTH = 0, 1, 2, 3


def join(a: Column, b: Column) -> Column:
    return a.bitwiseOR(b)


def meet(a: Column, b: Column) -> Column:
    return a.bitwiseAND(b)


def vector_join(a: Column, b: Column) -> Column:
    """Position by position; the shorter vector is padded with neither."""
    return F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(NEITHER)).bitwiseOR(F.coalesce(y, F.lit(NEITHER))))


def vector_meet(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(NEITHER)).bitwiseAND(F.coalesce(y, F.lit(NEITHER))))


def contradicted(vector: Column) -> Column:
    return F.coalesce(F.exists(vector, lambda x: x == BOTH), F.lit(False))
