"""Vector columns: norms, cosines and validation, without leaving the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """Bind a computed value once: what a lambda closes over would be computed again for each element."""
    return F.transform(F.array(value), body)[0]


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """Unit length after scaling by the largest magnitude, so huge values keep their direction; zero stays zero."""

    def scaled(x: Column) -> Column:
        return let(F.array_max(F.transform(x, F.abs)), lambda top: F.transform(x, lambda e: F.when(top > 0, e / top).otherwise(0.0)))

    def divided(x: Column) -> Column:
        return let(F.sqrt(dot(x, x)), lambda norm: F.transform(x, lambda e: F.when(norm > 0, e / norm).otherwise(0.0)))

    return let(v, lambda x: let(scaled(x), divided))


def valid(v: Column, dimensions: int | None = None) -> Column:
    """Finite in every place, and of the given length."""
    finite = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))
    return finite if dimensions is None else finite & (F.size(v) == dimensions)
