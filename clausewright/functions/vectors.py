"""Column expressions over number arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double precision; null if either is null or lengths differ."""
    product = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), product)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(a: Column) -> Column:
    """The vector by its length; a zero vector stays."""
    return F.when(norm(a) == 0, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x.cast("double") / norm(a)))


def masked_mean(states: Column, mask: Column) -> Column:
    """The mean, of length one, of the vectors of an array whose mask is not zero; null for null or an empty array, zeros if all is masked."""
    kept = F.filter(F.arrays_zip(states.alias("s"), mask.alias("m")), lambda p: p["m"] != 0)
    width = F.size(F.try_element_at(states, F.lit(1)))
    zeros = F.transform(F.sequence(F.lit(1), width), lambda _: F.lit(0.0))
    total = F.aggregate(kept, zeros, lambda t, p: F.zip_with(t, p["s"], lambda x, y: x + y.cast("double")))
    return F.when(F.size(states) > 0, unit(F.transform(total, lambda x: x / F.greatest(F.size(kept), F.lit(1)))))
