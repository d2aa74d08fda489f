"""Small shared helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def attach_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Append the columns of a global aggregate (exactly one row) to every row.

    The one-row frame becomes a scalar subquery: Spark runs it once, before
    the main stage, and inlines the value; no join and no broadcast exchange.
    """
    cols = one_row.columns
    packed = one_row.select(F.struct(*cols).alias("_s")).scalar()
    out = df.withColumn("_s", packed)
    return out.select("*", *[F.col("_s")[c].alias(c) for c in cols]).drop("_s")


def let(value: Column, fn) -> Column:
    """Evaluate ``value`` once and pass it to ``fn`` as a lambda variable.

    Spark does not share subexpressions inside higher-order lambdas: an
    array expression referenced in a ``transform`` body is recomputed for
    every element.  Binding it through a one-element ``transform`` evaluates
    it once per row.
    """
    return F.element_at(F.transform(F.array(value), lambda v: fn(v)), 1)


def r6(c) -> Column:
    """Round a double to 6 places (sum order differs between engines)."""
    return F.round(col(c).cast("double"), 6)


def r4(c) -> Column:
    return F.round(col(c).cast("double"), 4)
