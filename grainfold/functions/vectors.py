"""Vectors as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from grainfold.functions.text import let


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalised(v: Column) -> Column:
    """Unit length; a vector of (almost) nothing stays as small as it is."""
    return let(v, lambda u: let(F.greatest(F.sqrt(dot(u, u)), F.lit(1e-12)), lambda n: F.transform(u, lambda x: x.cast("double") / n)))


def percentile(values: Column, p: float) -> Column:
    """The p-th percentile (0 to 100) of an array by linear interpolation, equal values giving exactly that value."""
    def between(v: Column) -> Column:
        place = (F.size(v) - 1) * F.lit(p / 100)
        low = F.floor(place).cast("int")
        a, b, t = v[low], v[F.least(low + 1, F.size(v) - 1)], place - low
        return F.when(t < 0.5, a + (b - a) * t).otherwise(b - (b - a) * (1 - t))

    return let(F.sort_array(values), between)
