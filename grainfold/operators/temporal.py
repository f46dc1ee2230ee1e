"""Joins over time: the latest row up to a moment, intervals that hold a point, intervals that meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainfold.session import stash


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_at: str, right_at: str, take: list[str], ranges: int | None = None) -> DataFrame:
    """left with the columns `take` of the row of right that is, of those with equal `by`, the latest up to left_at.

    Both sides go into one order by key and time, dealt into ranges, so that a key with most rows is many tasks; within a
    range the last row of right is carried forward. Only a range's last key goes on into the next range, so what is carried
    over from range to range is a row a range. Of rows of right with one key and time the greatest in `take` counts.
    Nulls in a key or a time meet nothing; each row of left stays, with nulls where there is none. ranges: how many, if Spark
    is not to choose.
    """
    value = F.struct(*take)
    key = F.struct(*[F.col(c) for c in by])
    one = right.where(F.expr(" AND ".join(f"`{c}` IS NOT NULL" for c in (*by, right_at)))).select(*by, F.col(right_at).alias("__at"), value.alias("__value"))
    one = one.select(key.alias("__key"), "__at", "__value", F.lit(0).alias("__side"), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("__row"))
    two = left.select(key.alias("__key"), F.col(left_at).alias("__at"), F.lit(None).cast(one.schema["__value"].dataType).alias("__value"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__row"))
    both, order = one.unionByName(two), ["__key", "__at", "__side"]
    dealt = stash((both.repartitionByRange(ranges, *order) if ranges else both.repartitionByRange(*order)).withColumn("__part", F.spark_partition_id()), "asof")
    order = ["__at", "__side", "__value"]
    within = Window.partitionBy("__part", "__key").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    last = dealt.where("__side = 0").groupBy("__part", "__key").agg(F.max(F.struct(*order)).alias("__last"))
    ends = dealt.groupBy("__part").agg(F.max("__key").alias("__key"))
    out = ends.join(last, ["__part", "__key"], "left").select("__part", "__key", F.col("__last.__value").alias("__value"))  # a row a range
    before = Window.partitionBy("__key").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("__part").agg(F.min("__key").alias("__key")).join(out.select("__part", "__key", F.lit(True).alias("__end")), ["__part", "__key"], "left")
    chain = out.unionByName(starts.where("__end IS NULL").select("__part", "__key", F.lit(None).cast(out.schema["__value"].dataType).alias("__value")))
    carried = chain.select("__part", "__key", F.last("__value", ignorenulls=True).over(before).alias("__carried"))  # two rows a range
    met = dealt.withColumn("__seen", F.last("__value", ignorenulls=True).over(within)).where("__side = 1")
    met = met.join(F.broadcast(carried), ["__part", "__key"], "left")
    known = F.expr(" AND ".join(f"__row.`{c}` IS NOT NULL" for c in (*by, left_at)))
    found = F.when(known, F.coalesce("__seen", "__carried"))
    return met.withColumn("__found", found).select("__row.*", *[F.col("__found")[c].alias(c) for c in take])


def level(width: Column) -> Column:
    """The least j with 2 ** j >= width: an interval meets two bins of that size at most."""
    return F.ceil(F.log2(F.greatest(width.cast("double"), F.lit(1.0)))).cast("int")


def bins(start: Column, end: Column, size: Column) -> Column:
    """Numbers of the bins of a size that [start, end) meets."""
    at = lambda x: F.floor(x.cast("double") / size).cast("bigint")
    return F.sequence(at(start), at(F.greatest(end - 1, start)))


def interval_join(points: DataFrame, intervals: DataFrame, at: str, start: str, end: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Each point (whole number `at`) with each interval start <= at < end of equal `by`.

    An interval lies in bins of its own length's power of two, two at most; a point lies in one bin of each size that there
    is. So points and intervals meet by an equi-join on (by, size, bin), once, and the comparison comes after it. Sizes are
    at most 64 whatever the data. Intervals without length, and nulls, meet nothing.
    """
    held = intervals.where(F.col(start) < F.col(end)).withColumn("__level", level(F.col(end) - F.col(start)))
    held = held.withColumn("__bin", F.explode(bins(F.col(start), F.col(end), F.pow(F.lit(2.0), F.col("__level")))))
    levels = sorted(r[0] for r in held.select("__level").distinct().collect())  # 64 at most
    placed = points.withColumn("__level", F.explode(F.array(*[F.lit(j) for j in levels]).cast("array<int>")))
    placed = placed.withColumn("__bin", F.floor(F.col(at).cast("double") / F.pow(F.lit(2.0), F.col("__level"))).cast("bigint"))
    met = placed.join(held, [*by, "__level", "__bin"])
    return met.where((F.col(start) <= F.col(at)) & (F.col(at) < F.col(end))).drop("__level", "__bin")


def overlap_join(left: DataFrame, right: DataFrame, left_ends: tuple[str, str], right_ends: tuple[str, str], by: tuple[str, ...] = (), empty: bool = False) -> DataFrame:
    """Each pair of intervals of equal `by` that share a point, [start, end) both: the later start lies in the other interval,
    so that a pair is found as a point in an interval, once. Column names of both sides differ, but for `by`. With empty, the
    starts and ends alone are compared (a < d and c < b), so that an interval without length meets those around it."""
    (a, b), (c, d) = left_ends, right_ends
    one = interval_join(left, right, a, c, d, by).where(F.col(c) < F.col(b))
    two = interval_join(right, left, c, a, b, by).where((F.col(a) < F.col(c)) & (F.col(a) < F.col(d)))
    met = one.unionByName(two.select(*one.columns))
    return met if empty else met.where((F.col(a) < F.col(b)) & (F.col(c) < F.col(d)))
