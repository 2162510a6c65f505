"""A local name inside a Column expression."""

from pyspark.sql import Column, DataFrame, functions as F


def let(value: Column, body) -> Column:
    """body(value), with value computed once per row.

    Written as a lambda over a one-element array. The optimizer cannot copy the
    value into each place that uses it, and long bodies stay out of whole-stage
    code, which they would push over the size a method may have.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add costly columns that later filters and joins use.

    A filter on a projected column is moved below it and computes it again; a
    generator in between keeps the work to once per row.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
